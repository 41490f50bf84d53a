"""Sharding by minimax contiguous partition.

Equal texts are one atomic group. The groups stand in a fixed order: those above a share of all bytes by size, largest
first, then the others by a hash of their text. The smallest feasible shard capacity is found by binary search; a
capacity is feasible if filling shard after shard greedily, cutting before the first group that would not fit, needs no
more shards than asked. The cuts of that capacity are the result.

The driver never holds all groups: it holds the large ones, whose number has a bound, and sums of hash ranges. Ranges
that a cut can fall into for any capacity still possible are split into finer ones by a job each round, until all such
ranges are single groups; so the capacity and the cuts are exact.

Defined results: a null text has size 1, checksum 0 and is a group of its own kind (all null texts together); an empty
text likewise is one of size 1. Repeated rows each get a slot. Null doc_ids are kept and come first. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

SHARDS = 16
#: Groups above 1 / LARGE of all bytes are placed by size; there are at most LARGE of them.
LARGE = 16_384
#: Bits of the group key, of the first hash ranges, and of each further split.
KEY_BITS, FIRST_BITS, NEXT_BITS = 60, 12, 8
#: Slots are counted in so many hashed parts of a shard.
SLOT_PARTS = 1024


@dataclass(frozen=True)
class Atom:
    """A group, or a hash range of groups that may still be split. low: its first key; bits: of the range's prefix."""

    size: int
    whole: bool
    low: int = -1
    bits: int = KEY_BITS


class Line:
    """Atoms in order, with sums before them."""

    def __init__(self, atoms: list[Atom]):
        self.atoms = atoms
        self.sums = [0]
        for a in atoms:
            self.sums.append(self.sums[-1] + a.size)

    def cut(self, begin: float, capacity: int, split: bool) -> float:
        """The end of a shard that begins at `begin`; split: a range may be cut anywhere, which bounds what its groups allow."""
        to = begin + capacity
        if to >= self.sums[-1]:
            return self.sums[-1]
        i = bisect_right(self.sums, to) - 1  # atom i holds the end
        return to if split and not self.atoms[i].whole else self.sums[i]

    def cuts(self, capacity: int, shards: int, split: bool) -> list[float]:
        out, at = [], 0.0
        for _ in range(shards):
            at = max(at, self.cut(at, capacity, split))
            out.append(at)
        return out

    def smallest(self, shards: int, split: bool) -> int:
        """The least capacity with which greedy filling reaches the end."""
        low, high = -(-self.sums[-1] // shards), max(1, self.sums[-1])
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, split)[-1] >= self.sums[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def split_ranges(groups: DataFrame, atoms: list[Atom], want: list[Atom]) -> list[Atom]:
    """The line with the wanted ranges replaced by finer ones."""
    finer: dict[tuple[int, int], list[Atom]] = {}
    for bits in {a.bits for a in want}:
        to = min(KEY_BITS, bits + NEXT_BITS)
        prefixes = [a.low >> (KEY_BITS - bits) for a in want if a.bits == bits]
        found = groups.where(F.shiftright("key", KEY_BITS - bits).isin(prefixes)).groupBy(F.shiftright("key", KEY_BITS - to).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"))
        for r in sorted(found.collect()):
            low = r["low"] if r["n"] == 1 else r["prefix"] << (KEY_BITS - to)
            finer.setdefault((bits, r["prefix"] >> (to - bits)), []).append(Atom(r["size"], r["n"] == 1, low, to))
    out: list[Atom] = []
    for a in atoms:
        out += finer.get((a.bits, a.low >> (KEY_BITS - a.bits)), [a]) if a in want else [a]
    return out


def plan(groups: DataFrame, shards: int) -> tuple[dict[int, int], list[int], int]:
    """Shards of the large groups by key, the keys at which shards begin among the others (a list of `shards - 1`), the capacity.

    groups: (key, size), a row a key.
    """
    total = groups.agg(F.sum("size")).collect()[0][0] or 0
    large = [(r["key"], r["size"]) for r in groups.where(F.col("size") * LARGE > total).collect()]
    large.sort(key=lambda x: (-x[1], x[0]))
    rest = groups.where(F.col("size") * LARGE <= total)
    shift = KEY_BITS - FIRST_BITS
    first = rest.groupBy(F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"))
    ranges = [Atom(r["size"], r["n"] == 1, r["low"] if r["n"] == 1 else r["prefix"] << shift, FIRST_BITS) for r in sorted(first.collect())]
    atoms = [*(Atom(size, True) for _, size in large), *ranges]
    while True:
        line = Line(atoms)
        low, high = line.smallest(shards, True), line.smallest(shards, False)
        least, most = line.cuts(low, shards, False), line.cuts(high, shards, True)
        want = []
        for a, b in zip(least, most, strict=True):
            i, j = bisect_right(line.sums, a) - 1, bisect_left(line.sums, b)
            want += [x for x in atoms[max(0, i) : j] if not x.whole]
        if not want:
            break
        atoms = split_ranges(rest, atoms, list(dict.fromkeys(want)))
    ends = line.cuts(high, shards, False)
    placed = [bisect_right(ends, s) for s in line.sums[:-1]]
    by_key = {k: placed[i] for i, (k, _) in enumerate(large)}
    begins = []
    for shard in range(1, shards):
        i = bisect_left(placed, shard, lo=len(large))
        begins.append(atoms[i].low if i < len(atoms) else 1 << KEY_BITS)
    return by_key, begins, high


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; slots follow hashed parts, then ids.

    The text is read once; only keys and sizes are kept. The capacity comes from `plan`.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    key = F.conv(F.substring(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("n")), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), key.alias("key")), lasting=True)
    with scratch(spark):
        by_key, begins, _ = plan(stored(rows.groupBy("key").agg(F.sum("size").alias("size"))), shards)
    large = spark.createDataFrame(list(by_key.items()) or [(-1, 0)], "key long, large_shard int").coalesce(1)
    by_range = sum((F.when(F.col("key") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    placed = rows.join(F.broadcast(large), "key", "left").withColumn("shard", F.coalesce("large_shard", by_range).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_PARTS)).cast("int"))
    # at most shards * SLOT_PARTS counts
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return placed.withColumn("inside", inside).join(F.broadcast(counts), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_shards": op2_shards}
ORACLES: dict[str, str] = {}
