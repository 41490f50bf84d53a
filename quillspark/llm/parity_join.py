"""N-gram Jaccard join by parity sketches.

A document is the set of 64-bit hashes of its word windows. Two sets of sizes a and b with Jaccard similarity of at
least t differ in at most D = (a + b)(1 - t)/(1 + t) hashes. Sizes fall into bands so wide that partners lie in the same
band or the next. In a band the hashes are dealt to parts, more than D of them; each part's hashes are XORed into a
signature. Each differing hash can change one part only, so partners agree on some part: documents meet if they share a
signature in a band. Parts without hashes agree for nothing; a document with more of them than the spare parts cover is
dealt anew by another hash under a common key, so no pair is lost.

Documents that met are compared by parity sketches, bit vectors in which each hash flips a bit: the Hamming distance of
two never exceeds the sets' difference. Pairs that pass are verified on the whole sets, in the task that compares them,
which yields only links that join components: fewer than it holds documents, whatever the number of passing pairs.

1. Each document's largest meeting is dealt to blocks, each document once, and a task compares the pairs of a block.
2. Meetings of several blocks that hold several components are taken again, with three members of each component; those
of the components that hold much of the meeting go to all blocks. This is repeated while it links anything.
3. Meetings that still hold several components are compared as a whole, but for pairs inside the largest component: its
blocks meet the blocks of the others, and these each other.

In each step sketches alone tell which members of a block may have a partner there: first short ones, then, of what is
left, long ones. A pair that meets in many blocks is left to the first meeting of those that both are still in. Only the
sets of members that such a pair needs are made and follow in a last shuffle. So a link is missed only inside a component, which stays as it is. Links are the verified edges, and equal sets, which
are one representative from the start. Blocks hold at most BLOCK documents and about HASHES hashes. Rows are copied only
to blocks of a meeting whose members don't link: step 3 makes a copy for each block of the smaller components.

Defined results: a null or empty text, or one without words, has 0 shingles and no links. A repeated row is a copy.
A row with a null id takes part like any other; it counts after all ids, so a component without ids has a null
component_id. Rows of one id with different texts are one document for links, which any of its texts may have. If an id
reaches 2^62, ids are numbered in their order and the numbers stand for them inside. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bytes_of, drop_shuffles, joined, map_arrow, mixed, partitions, scratch, shingle_hashes, slices, small, stored, table, tidied

#: Documents of a block, and about the hashes that it holds; a task compares one block, or two with each other.
BLOCK, HASHES = 1024, 1 << 20
#: Dealings of a document's hashes to parts before the key of empty parts alone is used.
DEALS = 6
#: Least parts of the signatures to a shuffle partition, and signatures of a part.
PARTS, KEYS = 4, 400_000
#: Signatures that a task gathers before it looks for those of very many documents, which it passes on at once.
GATHERED = 2_000_000
#: A component that holds at least one in so many members of a meeting is shown to all blocks of step 2.
SHOWN = 64
#: Meetings by which a document's pairs are told to have met.
LISTED = 64
#: Low bits of a signature that hold its band; keys of rows without an id begin here; mark of a meeting named by its signature.
BAND_BITS, FREE, NAMED = 12, 1 << 62, -7
U = np.uint64


@dataclass(frozen=True)
class Bands:
    """Similarity of at least num / den, as bands of set sizes."""

    num: int
    den: int

    def starts(self, largest: int) -> list[int]:
        """First sizes of the bands, beyond `largest`."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, out[-1] * self.den**2 // self.num**2))
        return [*out, max(out[-1] + 1, out[-1] * self.den**2 // self.num**2)]

    def partner(self, size: int) -> int:
        """The largest partner of a set of this size."""
        return size * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    @lru_cache(maxsize=100_000)  # noqa: B019  bands are a constant or two
    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(band, most that partners of the band differ in, bits of its sketches): its own, and the one below if that has smaller partners."""
        starts = self.starts(size)
        own = int(np.searchsorted(starts, size, side="right")) - 1
        out = []
        for band in (own, own - 1):
            if band >= 0 and (band == own or size <= self.partner(starts[band + 1] - 1)):
                top = starts[band + 1] - 1
                d = self.differ(top, self.partner(top))
                out.append((band, d, 64 << (d // 4).bit_length()))
        return out


def signatures(hashes: np.ndarray, band: int, differ: int) -> np.ndarray:
    """Keys of a set in a band; any partner of the band shares one."""
    spare = 0 if differ < 8 else 2 + differ // 50
    parts = differ + 1 + spare
    key, out, mark = mixed(np.array([band + 1], U)), [], U(min(band, (1 << BAND_BITS) - 1))
    for deal in range(DEALS):
        where = (mixed(hashes + U(deal * 0x51ED27 + 1)) % U(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(where, kind="stable")  # a radix sort of short numbers
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        xors = np.bitwise_xor.reduceat(hashes[order], first)
        out.append(mixed(mixed(xors + key) + where[first].astype(U) * U(0x9E3779B97F4A7C15) + U(parts)))
        if parts - len(first) <= spare:
            break
        key = mixed(key + U(deal + 77))
    else:
        out.append(key)
    return np.concatenate(out) >> U(BAND_BITS) << U(BAND_BITS) | mark


def sketch(hashes: np.ndarray, bits: int) -> bytes:
    """Parity of the hashes at each of `bits` places, a power of two of at least 64."""
    flips = np.bincount((mixed(hashes + U(0xABCDEF)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def key(id_: Column, text: Column) -> Column:
    """A row's key: its id, or above all ids a hash of its text."""
    free = F.xxhash64(F.lit("no id"), text.cast("string")).bitwiseAND(F.lit(FREE - 1)).bitwiseOR(F.lit(FREE))
    return F.coalesce(id_.cast("long"), free)


def numbered(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(id, number): numbers below FREE in the order of the ids; None if the ids are such themselves."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if not ids.where(F.col("id") >= FREE).limit(1).count():
        return None
    found = ids.where("id IS NOT NULL").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return stored(found.withColumn("number", F.monotonically_increasing_id()), lasting=True)


def word_sets(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(id, n, h1, h2, sketch, short): size, 128-bit digest, sketch, and this folded to a half, of each document's set."""
    cache = WordHashes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, h1, h2, sk, short = [], [], [], [], []
        for text in bytes_of(b):
            s = shingle_hashes(text.lower().split(), width, cache)
            n.append(len(s))
            h1.append(int(mixed(s).sum(dtype=U)) - 2**63)
            h2.append(int(mixed(s ^ U(0x5555)).sum(dtype=U)) - 2**63)
            sk.append(sketch(s, bands.of(len(s))[0][2]) if len(s) else b"")
            short.append(np.bitwise_xor.reduce(np.frombuffer(sk[-1], U).reshape(2, -1), axis=0).tobytes() if len(sk[-1]) > 64 else sk[-1])
        return pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.int64()) for c in (n, h1, h2)), *(pa.array(c, pa.binary()) for c in (sk, short))], ["id", "n", "h1", "h2", "sketch", "short"])

    return map_arrow(docs, run, "id long, n long, h1 long, h2 long, sketch binary, short binary")


def parts_for(sets: DataFrame, bands: Bands) -> int:
    """Parts of about KEYS signatures each, PARTS to a shuffle partition at least."""
    t = bands.num / bands.den
    each = 1.9 * (1 + 1 / t) * (1 - t) / (1 + t)  # signatures to a hash: of its own band, and half the time of the one below
    keys = sets.agg(F.sum(F.col("n") * each + 4)).collect()[0][0] or 0
    return max(PARTS * partitions(sets.sparkSession), int(keys / KEYS))


def dealt(docs: DataFrame, width: int, bands: Bands, parts: int) -> DataFrame:
    """(part, keys, ids): packed signatures and the ids they belong to, by part of the keys."""
    cache = WordHashes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, ids = [], []
        for i, text in zip(b.column("id").to_pylist(), bytes_of(b), strict=True):
            s = shingle_hashes(text.lower().split(), width, cache)
            for band, differ, _ in bands.of(len(s)) if len(s) else ():
                keys.append(signatures(s, band, differ))
                ids.append(np.full(len(keys[-1]), i, np.int64))
        if not keys:
            return None
        k, d = np.concatenate(keys), np.concatenate(ids)
        part = (k >> U(30)) % U(parts)
        order = np.argsort(part, kind="stable")
        k, d, part = k[order], d[order], part[order]
        held, first = np.unique(part, return_index=True)
        ends = [*first[1:].tolist(), len(k)]
        cut = lambda x: pa.array([x[a:e].tobytes() for a, e in zip(first.tolist(), ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), cut(k), cut(d)], ["part", "keys", "ids"])

    return map_arrow(docs, run, "part int, keys binary, ids binary")


class Gathered:
    """The signatures of one part, as they come, and the meetings they make.

    A signature that fills a quarter of what may be gathered is passed on from then on, under its own name, so memory
    doesn't follow the number of its documents; the size of such a meeting is counted later.
    """

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.n, self.limit = 0, GATHERED
        self.wide = np.empty(0, U)

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(self.wide):
            out = np.isin(keys, self.wide)
            yield from self.named(keys[out], ids[out])
            keys, ids = keys[~out], ids[~out]
        self.keys.append(keys)
        self.ids.append(ids)
        self.n += len(keys)
        if self.n > self.limit:
            keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
            found, n = np.unique(keys, return_counts=True)
            self.wide = np.union1d(self.wide, found[n > GATHERED // 4])
            out = np.isin(keys, self.wide)
            yield from self.named(keys[out], ids[out])
            self.keys, self.ids = [keys[~out]], [ids[~out]]
            self.n = len(self.keys[0])
            self.limit = max(GATHERED, 2 * self.n)

    def named(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from _members(keys.view(np.int64), np.full(len(keys), NAMED), np.zeros(len(keys), np.int64), keys, ids)

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, ids = np.concatenate(self.keys), np.concatenate(self.ids)
        self.keys, self.ids = [], []
        order = np.argsort(keys, kind="stable")
        keys, ids = keys[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(first, len(keys)))
        keep = np.repeat(size > 1, size)
        keys, ids, size = keys[keep], ids[keep], size[size > 1]
        if not len(ids):
            return
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        g1 = np.add.reduceat(mixed(ids.astype(U)), first)
        g2 = np.add.reduceat(mixed(ids.astype(U) ^ U(0x77777)), first)
        _, once = np.unique(np.stack([g1, g2], 1), axis=0, return_index=True)
        once = np.sort(once)
        sizes = size[once]
        at = np.repeat(first[once] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        yield from _members(np.repeat(g1[once], sizes).view(np.int64), np.repeat(g2[once], sizes).view(np.int64), np.repeat(sizes, sizes), keys[at], ids[at])


def _members(g1: np.ndarray, g2: np.ndarray, size: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = [g1, g2, size, (keys & U((1 << BAND_BITS) - 1)).astype(np.int32), ids]
    for s in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 50_000]) for c in cols], ["g1", "g2", "size", "band", "id"])


def meetings(packed: DataFrame, parts: int) -> DataFrame:
    """(g1, g2, size, band, id), stored: members of each set of documents that share a signature; the same set comes once.

    Parts are sized by their number of signatures, 16 bytes each, and gathered one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, Gathered()
        for whole in batches:
            for b in slices(whole):
                for p, k, i in zip(*(b.column(c).to_pylist() for c in ("part", "keys", "ids")), strict=True):
                    if p != part:
                        yield from got.close()
                        part, got = p, Gathered()
                    yield from got.add(np.frombuffer(k, U), np.frombuffer(i, np.int64))
        yield from got.close()

    rows = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidied(run), "g1 long, g2 long, size long, band int, id long")
    # the same set of documents has the same members under any of its signatures, so all its rows get the same band
    found = stored(rows.groupBy("g1", "g2", "id").agg(F.max("size").alias("size"), F.max("band").alias("band")).select("g1", "g2", "size", "band", "id"))
    named = found.where((F.col("size") == 0) & (F.col("g2") == NAMED))
    sizes = stored(named.groupBy("g1", "g2").agg(F.count("*").alias("counted")))
    if not sizes.limit(1).count():
        return found
    return stored(found.join(small(sizes), ["g1", "g2"], "left").withColumn("size", F.coalesce("counted", "size")).drop("counted"))


def hashed(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, hashes) of documents with words."""
    cache = WordHashes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s) for i, text in zip(b.column("id").to_pylist(), bytes_of(b), strict=True) if len(s := shingle_hashes(text.lower().split(), width, cache))]
        cols = [[i for i, _ in rows], [len(s) for _, s in rows], [s.tobytes() for _, s in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "n", "hashes"])

    return map_arrow(docs, run, "id long, n long, hashes binary")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as words of 64 bits, folded by XOR to the length of the shortest."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), U)
    for i, s in enumerate(sketches):
        words = np.frombuffer(s, U)
        while len(words) > least:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[i] = words
    return out


class Cell:
    """Documents that one task compares, by size. side: 0 meets all, 1 meets 2 only. Documents of one label are not compared, nor those that have met `before`."""

    def __init__(self, n: list[int], sketches: list[bytes], label: list[int], side: list[int], bands: Bands, before: list[list[int]] | None = None):
        n_ = np.array(n, np.int64)
        self.order = np.argsort(n_, kind="stable")
        self.n, self.side, self.bands = n_[self.order], np.array(side)[self.order], bands
        self.root = np.unique(np.array(label, np.int64), return_inverse=True)[1][self.order]
        self.sketches = folded([sketches[i] for i in self.order])
        self.last = np.searchsorted(self.n, self.n * bands.den // bands.num, side="right")
        self.met = None
        if before is not None and any(before):
            listed = [before[i] for i in self.order]
            self.sizes = np.array(list(map(len, listed)))
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.met = np.unique(np.array([x for one in listed for x in one], np.int64), return_inverse=True)[1]
            self.seen = np.zeros(int(self.met.max()) + 1, bool)

    def first_met(self, i: int, at: np.ndarray) -> np.ndarray:
        """Of the places, those that i meets here first."""
        if self.met is None or not self.sizes[i] or not len(at):
            return at
        mine = self.met[self.begin[i] : self.begin[i] + self.sizes[i]]
        out, some = np.ones(len(at), bool), np.flatnonzero(self.sizes[at])
        if len(some):
            n, begin = self.sizes[at[some]], self.begin[at[some]]
            ends = np.cumsum(n)
            flat = np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)
            self.seen[mine] = True
            out[some] = ~np.logical_or.reduceat(self.seen[self.met[flat]], ends - n)
            self.seen[mine] = False
        return at[out]

    def partners(self, i: int) -> np.ndarray:
        """Places after i that may be partners, by label, side, size and sketch."""
        to = int(self.last[i])
        ok = self.root[i + 1 : to] != self.root[i]
        if self.side[i]:
            ok &= self.side[i + 1 : to] != self.side[i]
        at = np.flatnonzero(ok) + i + 1
        if not len(at):
            return at
        apart = np.bitwise_count(self.sketches[at] ^ self.sketches[i]).sum(axis=1, dtype=np.int64)
        return at[apart <= (self.n[i] + self.n[at]) * (self.bands.den - self.bands.num) // (self.bands.den + self.bands.num)]

    def may_link(self) -> np.ndarray:
        """Places, as given, that have a pair to verify."""
        out = np.zeros(len(self.n), bool)
        for i in range(len(self.n)):
            at = self.first_met(i, self.partners(i))
            out[at] = True
            out[i] |= len(at) > 0
        return self.order[out]

    def links(self, hashes: list[bytes]) -> list[tuple[int, int]]:
        """Verified pairs, as given, that connect whatever links connect: a forest over the labels."""
        sets = [np.frombuffer(hashes[i], U) for i in self.order]
        ends = np.cumsum([0, *map(len, sets)])
        where = marks = None
        out = []
        for i in range(len(sets)):
            at = self.partners(i)
            if not len(at):
                continue
            if where is None:
                where = np.unique(np.concatenate(sets), return_inverse=True)[1]
                marks = np.zeros(int(where.max()) + 1, bool)
            mine = where[ends[i] : ends[i + 1]]
            marks[mine] = True
            low, high = int(at[0]), int(at[-1]) + 1
            if 4 * len(at) > high - low:  # most of a stretch: at once
                same = np.add.reduceat(marks[where[ends[low] : ends[high]]], ends[low:high] - ends[low], dtype=np.int64)[at - low]
            else:
                same = np.array([np.count_nonzero(marks[where[ends[j] : ends[j + 1]]]) for j in at.tolist()])
            marks[mine] = False
            at = at[self.bands.den * same >= self.bands.num * (self.n[i] + self.n[at] - same)]
            if len(at):
                roots, first = np.unique(self.root[at], return_index=True)
                out += [(int(self.order[i]), int(self.order[j])) for j in at[first]]
                self.root[np.isin(self.root, roots)] = self.root[i]
        return out


CELL = ["g1", "g2", "lo", "hi"]


def by_cell(rows: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """f(first row's key, the columns' lists) -> lists of output columns, for each cell of rows."""
    kinds = [pa.int64() if part.split()[1] == "long" else pa.int32() for part in schema.split(", ")]
    names = [part.split()[0] for part in schema.split(", ")]
    dealt_ = rows.select(*CELL, *columns).repartition(partitions(rows.sparkSession), *CELL).sortWithinPartitions(*CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                out.extend(f(now, [list(c) for c in zip(*held, strict=True)]))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for whole in batches:
            for b in slices(whole):
                keys = list(zip(*(b.column(c).to_pylist() for c in CELL), strict=True))
                for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True):
                    if k != now:
                        close()
                        now = k
                    held.append(row)
                if len(out) > 10_000:
                    yield batch()
        close()
        yield batch()

    return dealt_.mapInArrow(tidied(run), schema)


def cell_links(rows: DataFrame, held: DataFrame, bands: Bands) -> DataFrame:
    """(a, b), stored: verified links of rows (g1, g2, lo, hi, side, id, label) that connect what any links of a cell connect."""

    def links(_: tuple, cols: list[list]) -> list[tuple[int, int]]:
        side, ids, label, n, hashes = cols
        if len(set(label)) < 2:
            return []
        bits = bands.of(max(n))[0][2]
        cell = Cell(n, [sketch(np.frombuffer(h, U), bits) for h in hashes], label, side, bands)
        return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in cell.links(hashes)]

    return stored(by_cell(rows.join(held, "id"), ["side", "id", "label", "n", "hashes"], links, "a long, b long").distinct())


def may_link(rows: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The rows (g1, g2, lo, hi, side, id, label) that sketches leave with a partner to verify in their cell, stored."""
    schema = "g1 long, g2 long, lo int, hi int, side int, id long, label long"

    def some(now: tuple, cols: list[list]) -> list[tuple]:
        side, ids, label, n, sk, *before = cols
        if len(set(label)) < 2:
            return []
        earlier = [[x for x in met if x < now[0]] for met in before[0]] if before else None
        return [(*now, side[i], ids[i], label[i]) for i in Cell(n, sk, label, side, bands, earlier).may_link().tolist()]

    columns = ["side", "id", "label", "n"]
    few = stored(by_cell(rows.join(sketches.select("id", "n", "short"), "id"), [*columns, "short"], some, schema).distinct())
    drop_shuffles(rows.sparkSession)
    # a pair that passes does so wherever it meets: the smallest meeting that both are left in is to verify it; the
    # smallest ones tell nearly all such pairs, and a pair that they don't tell is verified more than once
    met = few.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("g1")), 1, LISTED).alias("met"))
    return stored(by_cell(few.join(sketches.select("id", "n", "sketch"), "id").join(met, "id"), [*columns, "sketch", "met"], some, schema).distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ends of links (a, b): the smallest id that links reach.

    Labels fall to the least of the neighbours' and then to their label's own label, round by round, each round written
    to the shared scratch folder, until none changes.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("label"))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        # a label that is its own, as that of a large component, has no row here
        jump = small(labels.where("id <> label").select(F.col("id").alias("next"), F.col("label").alias("far")))
        found = stored(lower.join(jump, "next", "left").select("id", "old", F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = found.select("id", "label")
        if not found.where(F.col("old") != F.col("label")).limit(1).count():
            return labels


class Search:
    """Links of documents that met, found in the three steps of the module's text.

    docs (id, text) are those that stand for sets, sketches (id, n, sketch, short) theirs at least.
    """

    def __init__(self, members: DataFrame, sketches: DataFrame, docs: DataFrame, width: int, bands: Bands, largest: int):
        self.members, self.sketches, self.docs, self.width, self.bands = members, sketches, docs, width, bands
        starts = bands.starts(largest)
        # documents of a block, by band
        rooms = [max(1, min(BLOCK, HASHES // bands.partner(s - 1))) for s in starts[1:]]
        self.room = F.element_at(F.array(*map(F.lit, rooms)), F.least(F.col("band") + 1, F.lit(len(rooms))))
        empty = members.sparkSession.createDataFrame([], "a long, b long")
        self.links, self.labels = empty, empty.select(F.col("a").alias("id"), F.col("b").alias("label"))
        self.held: DataFrame | None = None

    def blocks(self, n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / self.room)).cast("int")

    def block(self, blocks: str) -> Column:
        return F.pmod(F.xxhash64("id", "g1"), F.col(blocks)).cast("int")

    def add(self, rows: DataFrame) -> bool:
        """Whether cells gave new links. Sketches tell whose sets are needed; those are made once of a text."""
        some = may_link(rows, self.sketches, self.bands)
        ids = some.select("id").distinct()
        if self.held is not None:
            ids = ids.join(self.held.select("id"), "id", "left_anti")
        ids = stored(ids)
        if ids.limit(1).count():
            new = stored(hashed(self.docs.join(small(ids), "id", "left_semi"), self.width))
            self.held = new if self.held is None else self.held.unionByName(new)
        elif not some.limit(1).count():
            return False
        found = cell_links(some, self.held, self.bands)
        if not found.limit(1).count():
            return False
        self.links = stored(self.links.unionByName(found).distinct()) if self.labels.limit(1).count() else found
        self.labels = components(self.links)
        return True

    def labelled(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.labels, "id", "left").withColumn("label", F.coalesce("label", "id"))

    def run(self) -> DataFrame:
        """(a, b), links that connect each component."""
        largest = self.members.groupBy("id").agg(F.max_by(F.struct("g1", "g2"), F.struct("size", "g1", "g2")).alias("g")).select("g.g1", "g.g2").distinct()
        first = self.members.join(small(stored(largest)), ["g1", "g2"], "left_semi").withColumn("blocks", self.blocks(F.col("size")))
        first = stored(first.withColumn("lo", self.block("blocks")))
        cell = lambda rows: rows.select("g1", "g2", "lo", F.lit(0).alias("hi"), F.lit(0).alias("side"), "id", "label")
        self.add(cell(first.withColumn("label", F.col("id"))))
        wide = first.where("blocks > 1").select("g1", "g2", "band", "id")
        while wide.limit(1).count():
            shown = self.shown(wide)
            if not self.add(cell(shown)):
                break
            wide = shown.where("blocks > 1").select("g1", "g2", "band", "id").distinct()
        self.rest(first.where("blocks = 1").select("g1", "g2").distinct())
        return self.links

    def shown(self, wide: DataFrame) -> DataFrame:
        """Step 2: three members of each component of meetings (g1, g2, band, id) that hold several, in blocks; stored."""
        degree = self.links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        rows = self.labelled(wide).join(degree, "id", "left").withColumn("h", F.xxhash64("id"))
        named = rows.groupBy("g1", "g2", "band", "label").agg(F.count("*").alias("n"), F.max_by("id", F.struct(F.coalesce("degree", F.lit(0)), "id")).alias("x"), F.max_by("id", "h").alias("y"), F.min_by("id", "h").alias("z"))
        named = stored(named.select("g1", "g2", "band", "label", "n", F.array_distinct(F.array("x", "y", "z")).alias("ids")))
        total = named.groupBy("g1", "g2").agg(F.sum("n").alias("total"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
        named = stored(named.join(total, ["g1", "g2"]).withColumn("all", F.col("n") * SHOWN >= F.col("total")))
        few = named.groupBy("g1", "g2", "band").agg(F.sum(F.when(F.col("all"), 0).otherwise(F.size("ids"))).alias("few"))
        few = few.select("g1", "g2", self.blocks(F.col("few")).alias("blocks"))
        each = named.join(few, ["g1", "g2"]).select("g1", "g2", "band", "label", "blocks", "all", F.explode("ids").alias("id"))
        where = F.when(F.col("all"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(self.block("blocks")))
        return stored(each.withColumn("lo", F.explode(where)).drop("all"))

    def rest(self, complete: DataFrame) -> None:
        """Step 3: meetings that hold several components, but for those compared as a whole."""
        rows = self.labelled(self.members.join(small(stored(complete)), ["g1", "g2"], "left_anti"))
        named = rows.groupBy("g1", "g2", "band", "label").agg(F.count("*").alias("n"))
        held = named.groupBy("g1", "g2", "band").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("labels")).where("labels > 1")
        one = F.col("total") <= self.room
        held = stored(held.select("g1", "g2", "major", F.when(one, 0).otherwise(self.blocks(F.col("most"))).alias("majors"), F.when(one, 1).otherwise(self.blocks(F.col("total") - F.col("most"))).alias("minors")))
        if not held.limit(1).count():
            return
        mixed_ = rows.drop("size", "band").join(small(held), ["g1", "g2"])
        # blocks of the largest component, numbered below 0, meet those of the others; these meet each other
        major = (F.col("label") == F.col("major")) & (F.col("majors") > 0)
        mine = F.when(major, self.block("majors")).otherwise(self.block("minors"))
        cell = lambda lo, hi, side: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"))
        upto = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda i: i < F.col(n))
        of_major = F.transform(upto("minors"), lambda j: cell(-1 - F.col("mine"), j, F.lit(1)))
        with_major = F.transform(upto("majors"), lambda i: cell(-1 - i, F.col("mine"), F.lit(2)))
        with_minor = F.transform(upto("minors"), lambda j: cell(F.least("mine", j), F.greatest("mine", j), F.when(j == F.col("mine"), 0).when(F.col("mine") < j, 1).otherwise(2)))
        cells = mixed_.withColumn("mine", mine).select("g1", "g2", "id", "label", F.explode(F.when(major, of_major).otherwise(F.concat(with_major, with_minor))).alias("c"))
        self.add(cells.select("g1", "g2", "c.*", "id", "label"))


def grouped(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(id, n, label, links) for each row of docs (id: its key, text).

    Texts are read for the sets' digests and sketches, for the signatures of one document of each set, and, of documents
    that sketches leave with a partner, for hashes.
    """
    with scratch(docs.sparkSession):
        sets = stored(word_sets(docs, width, bands), lasting=True)
        sketches = sets.where("n > 0").select("id", "n", "sketch", "short")
        if sets.groupBy("id").count().where("count > 1").limit(1).count():
            docs = stored(docs.dropDuplicates(["id", "text"]))
            sketches = stored(sets.where("n > 0").groupBy("id", "n", "h1", "h2").agg(F.min("sketch").alias("sketch"), F.min("short").alias("short")).select("id", "n", "sketch", "short"))
        # one document stands for each set; its other ids hang on it
        first = stored(sets.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
        others = stored(sets.select("id").distinct().join(first.select(F.col("rep").alias("id")), "id", "left_anti"))
        alone = docs.join(small(others), "id", "left_anti")
        parts = parts_for(first, bands)
        members = meetings(dealt(alone, width, bands, parts), parts)
        drop_shuffles(docs.sparkSession)
        search = Search(members, sketches, alone, width, bands, first.agg(F.max("n")).collect()[0][0] or 1)
        links = search.run()
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
        named = first.join(search.labels.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
        named = named.select("n", "h1", "h2", "copies", "rep", F.coalesce("label", "rep").alias("label"), (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links"))
        # sets that neither link nor have copies need no join
        named = stored(named.where("links > 0"), lasting=True)
    out = joined(sets, named, ["n", "h1", "h2"], "copies")
    links = F.when(F.col("id") == F.col("rep"), F.col("links")).when(F.col("rep").isNotNull(), 1).otherwise(0)
    return out.select("id", "n", F.coalesce("label", "id").alias("label"), links.cast("long").alias("links"))


def near_duplicates(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, links), a row for each row: links counts the verified links, which connect each component, and the copies' links to their first copy."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(docs.sparkSession):
        numbers = numbered(docs, "id")
    if numbers is not None:
        numbers = small(numbers)
        docs = docs.join(numbers, "id", "left").select(F.col("number").alias("id"), "text")
    rows = grouped(docs.select(key(F.col("id"), F.col("text")).alias("id"), "text"), width, Bands(num, den))
    given = lambda c: F.when(F.col(c) < FREE, F.col(c))
    rows = rows.select(given("id").alias("id"), F.col("n").alias("n_shingles"), given("label").alias("component_id"), "links")
    if numbers is None:
        return rows
    for c in ("id", "component_id"):
        rows = rows.join(numbers.select(F.col("id").alias("own"), F.col("number").alias(c)), c, "left").withColumn(c, F.col("own")).drop("own")
    return rows.select("id", "n_shingles", "component_id", "links")


def keep_one(docs: DataFrame, width: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row of its smallest id, with all columns of docs; of that row's copies, one."""
    name = "_key" + "_" * max(map(len, docs.columns))  # a name that docs has not
    with scratch(docs.sparkSession):
        numbers = numbered(docs, id_col)
        if numbers is None:
            keyed = docs.withColumn(name, key(F.col(id_col), F.col(text_col)))
        else:
            numbers = small(numbers.select(F.col("id").alias(name), F.col("number").alias(f"{name}_")))
            keyed = docs.join(numbers, F.col(id_col).cast("long") == F.col(name), "left").withColumn(name, key(F.col(f"{name}_"), F.col(text_col))).drop(f"{name}_")
        rows = stored(grouped(keyed.select(F.col(name).alias("id"), F.col(text_col).cast("string").alias("text")), width, Bands(num, den)))
        gone = stored(rows.where("id <> label").select(F.col("id").alias(name)).distinct(), lasting=True)
        repeated = rows.groupBy("id").count().where("count > 1").limit(1).count()
    kept = keyed.join(small(gone), name, "left_anti")
    if repeated:
        kept = kept.groupBy(name).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("row")).select("row.*")
    return kept.select(docs.columns)


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard similarity of 0.85 of their 4-word shingles."""
    out = near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i.a, i.b FROM i JOIN n p ON p.doc_id = i.a JOIN n q ON q.doc_id = i.b WHERE 100 * c >= 85 * (p.n + q.n - c)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, m.b FROM r JOIN m ON m.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2"""

QUERIES = {"op7_parity_join": op7_parity_join}
ORACLES = {"op7_parity_join": SQL}
