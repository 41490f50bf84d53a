"""Compressed postings of an index segment.

A segment's documents are ordered by their most frequent term and their length, so that documents of one kind stand
together, and numbered within stripes of at most WIDTH documents. The postings of a term in a stripe are cut into blocks:
aligned ranges of a power of two documents, of about BLOCK postings for a frequent term and the whole stripe for a rare
one. A block holds the gaps between its documents' numbers and their term frequencies, each packed to the bits that its
largest needs, and beside them the number of postings, the least and largest value that `weight` takes in it and, of a
block of some postings, a byte for each eighth of its range: the largest value there, in parts of the block's. So a query
tells from these few columns what a block can add to a score, and unpacks only blocks that matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: Documents, and postings, of a stripe; postings of a block; documents of the smallest range; parts of a range that have
#: bounds of their own; documents of the smallest part, a cell.
WIDTH, MOST, BLOCK, RANGE, PARTS = 4096, 1 << 19, 64, 128, 8
CELL = RANGE // PARTS
#: Rows and bytes of texts whose terms are counted at a time.
ROWS_AT_ONCE, SLICE = 512, 4 << 20
TOKEN = re.compile("[a-z0-9_$%]{3,}")
#: Weights lie below K1 + 1; bounds are kept in so many parts of that, and no `low` where it is `high`.
PARTS_OF_WEIGHT = 32_767
UNIT = (K1 + 1) / PARTS_OF_WEIGHT
#: A block of a term, or (term null) a stripe's documents; range: its first number and the power of two it
#: spans. A block of one posting of frequency 1 holds nothing; its range is that document.
ROWS = "stripe long, term string, begin int, span int, n int, low short, high short, tops binary, packed binary, ids array<{id}>, dls array<int>"
BLOCKS = ["stripe", "term", "begin", "span", "n", "low", "high", "tops", "packed"]


def weight(tf: np.ndarray, dl: np.ndarray, mean: float, k1: float = K1, b: float = B) -> np.ndarray:
    """What BM25 multiplies a term's idf with."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ROWS_AT_ONCE rows, and SLICE bytes of texts unless one text has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, min(at + ROWS_AT_ONCE, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf) of each row: its terms, counted where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            found = [Counter(TOKEN.findall(t)) if t is not None else {} for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(n) for n in found])
            cols = [b.column("id").take(pa.array(at)), pa.array((t for n in found for t in n), pa.string()), pa.array((x for n in found for x in n.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).mapInArrow(run, f"id {kind}, term string, tf long")


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, lead, terms, tfs): a row a document, its terms counted in it; lead: its most frequent term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            rows = []
            for t in b.column("text").to_pylist():
                tokens = TOKEN.findall(t) if t is not None else None
                n = Counter(tokens or ())
                rows.append((None if tokens is None else len(tokens), min(n, key=lambda x: (-n[x], x)) if n else None, list(n), list(n.values())))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["id", "dl", "lead", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).mapInArrow(run, f"id {kind}, dl int, lead string, terms array<string>, tfs array<int>")


def packed_bits(values: np.ndarray, widths: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """size bytes, in which each value lies in so many bits from its start on, least bit first."""
    ends = np.cumsum(widths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - widths, widths)
    bits = np.zeros(8 * size, np.uint8)
    bits[np.repeat(starts, widths) + at] = (np.repeat(values, widths) >> at) & 1
    return np.packbits(bits, bitorder="little")


def bits_of(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def unpacked(packed: bytes, begin: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, term frequencies) of a block."""
    if not packed:
        return np.array([begin]), np.array([1])
    w, v = packed[0], packed[1]
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=2), bitorder="little")
    tail = 8 * -(-n * w // 8)
    gaps = bits[: n * w].reshape(n, w) @ (1 << np.arange(w)) if w else np.zeros(n, np.int64)
    tfs = bits[tail : tail + n * v].reshape(n, v) @ (1 << np.arange(v)) if v else np.zeros(n, np.int64)
    return begin - 1 + np.cumsum(gaps + 1), tfs + 1


def values_at(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of so many bits, at most 32, that begin at bits `at` of bytes with five to spare."""
    byte = at >> 3
    out = data[byte].astype(np.int64)
    for k in range(1, 5):
        out |= data[byte + k].astype(np.int64) << (8 * k)
    return out >> (at & 7) & ((np.int64(1) << width) - 1)


def unpacked_all(packed: pa.Array, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, term frequencies) of many blocks, one after the other: unpacked() of each, in a few steps for all."""
    begin, n = begin.astype(np.int64), n.astype(np.int64)
    size = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(packed.to_pylist()) + bytes(8), np.uint8)
    head = np.cumsum(size) - size
    w, v = (np.where(size > 0, data[head + i], 0).astype(np.int64) for i in (0, 1))
    ends = np.cumsum(n)
    of = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(of)) - (ends - n)[of]
    first = 8 * (head + 2)
    gaps = values_at(data, np.where(w[of] > 0, first[of] + inside * w[of], 0), w[of])
    tfs = values_at(data, np.where(v[of] > 0, (first + 8 * -(-n * w // 8))[of] + inside * v[of], 0), v[of])
    steps = np.cumsum(gaps + 1)
    before = np.concatenate([[0], steps])[ends - n] if len(n) else steps
    return (begin - 1 - before)[of] + steps, tfs + 1


def blocks_of(no: np.ndarray, term: np.ndarray, tf: np.ndarray, dl: np.ndarray, mean: float) -> Iterator[tuple]:
    """(term number, begin, span, n, low, high, tops, packed) of a stripe's postings; dl: of each document."""
    order = np.lexsort((no, term))
    no, term, tf = no[order], term[order], tf[order]
    count = np.bincount(term)
    pieces = bits_of(np.maximum(0, -(-count // BLOCK) - 1))  # powers of two
    span = np.maximum(int(WIDTH).bit_length() - 1 - pieces, int(RANGE).bit_length() - 1)[term]
    part = no >> span
    new = np.ones(len(no), bool)
    new[1:] = (term[1:] != term[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(no)))
    begin = part[first] << span[first]
    gaps = np.empty(len(no), np.int64)
    gaps[1:] = no[1:] - no[:-1] - 1
    gaps[first] = no[first] - begin
    w, v = bits_of(np.maximum.reduceat(gaps, first)), bits_of(np.maximum.reduceat(tf - 1, first))
    size = 2 + -(-n * w // 8) + -(-n * v // 8)
    f = weight(tf.astype(np.float64), dl[no].astype(np.float64), mean)
    low = np.floor(np.minimum.reduceat(f, first) / UNIT).astype(np.int64)
    high = np.ceil(np.maximum.reduceat(f, first) / UNIT).clip(1, PARTS_OF_WEIGHT).astype(np.int64)
    # the largest of each part, rounded up to parts of the block's largest
    of = np.repeat(np.arange(len(first)), n)
    tops = np.zeros(len(first) * PARTS, np.float64)
    np.maximum.at(tops, of * PARTS + ((no - begin[of]) * PARTS >> span), f)
    tops = np.ceil(tops.reshape(-1, PARTS) / (high * UNIT)[:, None] * 255).clip(0, 255).astype(np.uint8)
    step = 1 << 12
    for a in range(0, len(first), step):
        s = slice(a, a + step)
        lo, hi = first[a], first[a] + n[s].sum()
        at = np.concatenate([[0], np.cumsum(size[s])])
        block = np.repeat(np.arange(len(n[s])), n[s])
        inside = np.arange(lo, hi) - first[s][block]
        head = 8 * (at[:-1] + 2)
        tail = head + 8 * -(-n[s] * w[s] // 8)
        values = np.concatenate([gaps[lo:hi], tf[lo:hi] - 1])
        widths = np.concatenate([w[s][block], v[s][block]])
        starts = np.concatenate([head[block] + inside * w[s][block], tail[block] + inside * v[s][block]])
        raw = packed_bits(values, widths, starts, int(at[-1]))
        raw[at[:-1]], raw[at[:-1] + 1] = w[s], v[s]
        whole = raw.tobytes()
        for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True), a):
            if n[i] == 1 and tf[first[i]] == 1:  # its number says all
                yield int(term[first[i]]), int(no[first[i]]), 0, 1, None, int(high[i]), b"", b""
                continue
            yield int(term[first[i]]), int(begin[i]), int(span[first[i]]), int(n[i]), int(low[i]) if n[i] > 1 else None, int(high[i]), tops[i].tobytes() if n[i] >= PARTS else b"", whole[x:y]


def cells_of(begin: int, span: int) -> slice:
    """Cells that a block's range reaches into."""
    return slice(begin // CELL, -(-(begin + (1 << span)) // CELL))


def most_of(blocks: Iterator[tuple[int, int, int, float, float, bytes, float]]) -> np.ndarray:
    """The most that documents of each cell of a stripe can score, from (begin, span, n, low, high, tops, gain) of its terms' blocks.

    A term of positive gain adds at most the largest weight of its part. One of negative gain adds nothing, unless its
    block holds every document of its range: then its least weight at least. Cells without a term of positive gain: 0.
    """
    most, met = np.zeros(WIDTH // CELL), np.zeros(WIDTH // CELL, bool)
    for begin, span, n, low, high, tops, gain in blocks:
        s = cells_of(begin, span)
        if gain > 0:
            each = np.repeat(np.frombuffer(tops, np.uint8), ((1 << span) // CELL) // PARTS) if tops else np.full(s.stop - s.start, 255)
            most[s] += gain * high / 255 * each
            met[s] |= each > 0
        elif n == 1 << span and span:
            most[s] += gain * low
    return np.where(met, most, 0.0)


def striped(rows: DataFrame, mean: float, parts: int) -> DataFrame:
    """ROWS of counted documents: each task numbers its range of the order and packs a stripe at a time."""
    kind = rows.schema["id"].dataType.simpleString()
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stripe, held, n = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            dl, lists, tf = whole.column("dl"), whole.column("terms").combine_chunks(), whole.column("tfs").combine_chunks()
            many = lists.value_lengths().to_numpy()
            coded = lists.flatten().dictionary_encode()
            blocks = blocks_of(np.repeat(np.arange(len(many)), many), coded.indices.to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), dl.fill_null(0).to_numpy(), mean) if many.sum() else iter(())
            texts = coded.dictionary.to_pylist()
            while True:
                some = [b for _, b in zip(range(8192), blocks, strict=False)]
                if not some:
                    break
                term, begin, span, count, low, high, tops, packed = zip(*some, strict=True)
                m = len(some)
                cols = [pa.array([stripe] * m, pa.int64()), pa.array([texts[i] for i in term]), pa.array(begin, pa.int32()), pa.array(span, pa.int32()), pa.array(count, pa.int32()), pa.array(low, pa.int16()), pa.array(high, pa.int16()), pa.array(tops, pa.binary()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.list_(whole.schema.field("id").type)), pa.nulls(m, pa.list_(pa.int32()))], names)
            ids = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column("id").combine_chunks())
            dls = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), dl.combine_chunks())
            nulls = [pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int16(), pa.int16(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int64()), *nulls, ids, dls], names)

        for b in batches:
            at = 0
            sizes = b.column("terms").value_lengths().fill_null(0).to_numpy().cumsum()
            while at < b.num_rows:
                before = sizes[at - 1] if at else 0
                to = min(b.num_rows, at + WIDTH - sum(x.num_rows for x in held), max(at + 1, int(np.searchsorted(sizes, before + MOST - n, side="right"))))
                held.append(b.slice(at, to - at))
                n += int(sizes[to - 1] - before)
                at = to
                if sum(x.num_rows for x in held) >= WIDTH or n >= MOST:
                    yield from flush()
                    stripe, held, n = stripe + 1, [], 0
        if held:
            yield from flush()

    order = [F.col("lead").asc_nulls_first(), F.desc("dl"), F.col("id")]
    dealt = rows.repartitionByRange(parts, *order, F.xxhash64("id", "terms")).sortWithinPartitions(*order)
    return dealt.select("id", "dl", "terms", "tfs").mapInArrow(run, ROWS.format(id=kind))
