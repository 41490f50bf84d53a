"""Mixture-controlled packing by deficit round-robin.

Documents are token streams in a queue for each source. A window of `window` tokens has window / slice places. In each
round every queue's deficit counter grows by its target share of the places; the queues are visited in order and send as
many whole slices as their counters hold, keeping the remainder for the next round. What is sent, in order, is cut into
windows. In exact integers the counters after r rounds are a closed form of r, so any task knows the state at any round
without running those before it: deficits carry across windows and partitions. When a queue can't fill a share of a round
any more, it leaves and the others share its places. What is left at the end (less than two slices of each queue, if
targets follow the corpus) fills the last sequences in a row; the last of all is cut at powers of two, which need no padding.

Defined results: a null or empty text is its end token alone; a null source is a queue of its own; repeated rows and
doc_ids are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import SMALL_ROWS, scratch, slices, stored, table, tidied

#: Tokens a sequence, tokens a slice, most queues (see `queues_of`), the token that ends a document.
WINDOW, SLICE, MAX_QUEUES, END = 4096, 256, 1024, 2
#: Characters of the encoder's leaves; any give the same tokens.
LEAF = 1 << 16


@dataclass
class Phase:
    """Rounds with the same queues. first: slices sent before; gain: weight times places of each queue, in visiting order."""

    first: int
    rounds: int
    total: int
    queues: list[int]
    gain: np.ndarray
    sent: dict[int, tuple[int, int]] = field(default_factory=dict)  # by queue: its place in the order, its slices sent before

    def after(self, rounds: int) -> np.ndarray:
        """Slices that each queue has sent after so many rounds."""
        return rounds * self.gain // self.total


class Plan:
    """Where each token of each queue goes."""

    #: Sum of the weights of a phase: shares are kept to one in so many, the rest is left to the next phase.
    SHARES = 1 << 20

    def __init__(self, tokens: list[int], weights: list[int] | None = None, window: int = WINDOW, slice_: int = SLICE):
        self.window, self.slice, self.places = window, slice_, window // slice_
        left = {q: t // slice_ for q, t in enumerate(tokens)}
        sent = dict.fromkeys(left, 0)
        active = [q for q, n in left.items() if n and (not weights or weights[q] > 0)]
        self.phases: list[Phase] = []
        first = 0
        while active:
            wanted = {q: weights[q] if weights else left[q] for q in active}
            all_ = sum(wanted.values())
            gain = np.array([max(1, self.SHARES * wanted[q] // all_) * self.places for q in active], np.int64)
            total = int(gain.sum()) // self.places
            rounds = min(left[q] * total // int(g) for q, g in zip(active, gain, strict=True))
            if rounds:
                phase = Phase(first, rounds, total, active, gain)
                if not phase.after(rounds).any():  # shares of a slice are all that is left
                    break
                for i, (q, n) in enumerate(zip(active, phase.after(rounds).tolist(), strict=True)):
                    phase.sent[q] = (i, sent[q])
                    sent[q], left[q], first = sent[q] + n, left[q] - n, first + n
                self.phases.append(phase)
            active = [q for q, g in zip(active, gain, strict=True) if left[q] * total // int(g)]
        self.of: dict[int, list[Phase]] = {q: [p for p in self.phases if q in p.sent] for q in left}
        self.head = [sent[q] * slice_ for q in left]
        self.rest_at, at = [], first * slice_
        for t, h in zip(tokens, self.head, strict=True):
            self.rest_at.append(at - h)
            at += t - h
        self.full, odd = divmod(at, window)
        self.last: list[tuple[int, int]] = []  # begin and length of the sequences after the full ones
        at, bit = self.full * window, window
        while odd:
            if odd >= bit:
                self.last.append((at, bit))
                at, odd = at + bit, odd - bit
            bit //= 2

    def run(self, q: int, phases: list[Phase], at: int) -> tuple[int, int]:
        """Of token `at` of queue q, within its rounds: place in what all queues send, and the token before which its turn ends."""
        j = at // self.slice
        phase = next(p for p in reversed(phases) if p.sent[q][1] <= j)
        i, before = phase.sent[q]
        gain = int(phase.gain[i])
        turn = -(-(j - before + 1) * phase.total // gain) - 1  # the round in which slice j goes
        now, then = phase.after(turn), phase.after(turn + 1)
        first = phase.first + int(now.sum()) + int((then[:i] - now[:i]).sum())
        begin = (before + int(now[i])) * self.slice
        return first * self.slice + at - begin, (before + int(then[i])) * self.slice

    def pieces(self, q: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before it, length, sequence, offset) of n tokens that begin at token `at` of queue q."""
        begin, end = at, at + n
        while at < end:
            place, stop = self.run(q, self.of[q], at) if at < self.head[q] else (self.rest_at[q] + at, end)
            stop = min(stop, end)
            while at < stop:
                seq, off = divmod(place, self.window)
                room = self.window - off
                if seq >= self.full:
                    k = max(k for k, (b, _) in enumerate(self.last) if b <= place)
                    seq, off, room = self.full + k, place - self.last[k][0], sum(self.last[k]) - place
                m = min(room, stop - at)
                yield at - begin, m, seq, off
                at, place = at + m, place + m


def tokenised(docs: DataFrame, path: str, width: str) -> DataFrame:
    """(part, queue source, doc_id, n, before, ids): ids with the end token; before: tokens of the same part and source so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tok, so_far = TaskContext.get().partitionId(), encoder(path), {}
        for whole in batches:
            for b in slices(whole):
                ids = [np.append(x, END).astype(width) for x in tok.encode_all(b.column("text").to_pylist(), LEAF)]
                n, before = [len(x) for x in ids], []
                for s, k in zip(b.column("source").to_pylist(), n, strict=True):
                    before.append(so_far.get(s, 0))
                    so_far[s] = before[-1] + k
                cols = [pa.array([part] * len(n), pa.int32()), b.column("source"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "source", "doc_id", "n", "before", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run, "bpe"), "part int, source string, doc_id long, n long, before long, ids binary")


def named(source: str | None) -> str:
    """The name of a source's own queue."""
    return "-" if source is None else f"={source}"


def queues_of(sums: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """sums(part, source, n) with `name` and `queue`.

    Up to MAX_QUEUES sources have a queue each. Of more, those with a target and the largest others keep theirs; half of
    MAX_QUEUES is theirs, or as many as there are targets. Only the small ones that are left share hashed queues, in what
    MAX_QUEUES leaves (one at least); none of these has a target, so a shared queue's weight is 0 where targets are given.
    """
    sums = sums.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")))
    if sums.select("name").distinct().limit(MAX_QUEUES + 1).count() <= MAX_QUEUES:
        return sums.withColumn("queue", F.col("name"))
    spark, schema = sums.sparkSession, "name string"
    own = [named(s) for s, t in (targets or {}).items() if t > 0]
    given = F.broadcast(spark.createDataFrame([(x,) for x in own], schema).coalesce(1))
    # every targeted source found counts, whether or not it is among the largest
    found = [r["name"] for r in sums.select("name").distinct().join(given, "name", "left_semi").collect()]
    room = max(0, MAX_QUEUES // 2 - len(found))
    large = sums.join(given, "name", "left_anti").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(room).collect() if room else []
    own = [*found, *(r["name"] for r in large)]
    kept = spark.createDataFrame([(x, x) for x in own], f"{schema}, queue string").coalesce(1)
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max(1, MAX_QUEUES - len(own)))).cast("string"))
    return sums.join(F.broadcast(kept), "name", "left").withColumn("queue", F.coalesce("queue", shared))


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, slice_: int = SLICE, path: str | None = None) -> DataFrame:
    """A row for each piece of a document in a sequence, with its queue.

    targets: token shares by source; sources without one are packed after the others. None: the corpus's own shares,
    so that every window holds the whole mixture. Texts are tokenised once into a scratch table; then only sums by
    part and source are shuffled. Sums by queue come to the driver: at most MAX_QUEUES, or one more than there are targets.
    """
    path = path or default_path()
    width = "<u2" if encoder(path).library.get_vocab_size() <= 0xFFFF else "<u4"
    spark = docs.sparkSession
    with scratch(spark):
        tokens = stored(tokenised(docs, path, width), lasting=True)
        sums = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
        # a part's sources that share a queue follow one another
        order = Window.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        per_part = queues_of(sums, targets)
        totals = {r["queue"]: r["n"] for r in per_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
        names = sorted(totals)
        weights = {named(x): max(1, round(1e6 * t)) for x, t in (targets or {}).items() if t > 0}
        plan = Plan([totals[x] for x in names], None if targets is None else [weights.get(x, 0) for x in names], window, slice_)
        numbers = {x: i for i, x in enumerate(names)}
        starts = per_part.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0))).select("part", "name", "queue", "first")
        rows = tokens.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
        starts = stored(starts, lasting=True)
    placed = rows.join(F.broadcast(starts) if starts.count() <= SMALL_ROWS else starts, ["part", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 256):
                out: list[tuple] = []
                for doc, q, begin, n, raw in zip(*(b.column(x).to_pylist() for x in ("doc_id", "queue", "begin", "n", "ids")), strict=True):
                    ids = np.frombuffer(raw, width).astype("<u4")
                    out += [(doc, s, k, zlib.crc32(ids[s : s + k].tobytes()), n, seq, off, q) for s, k, seq, off in plan.pieces(numbers[q], begin, n)]
                cols = list(zip(*out, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.string())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    return placed.select("doc_id", "queue", (F.col("first") + F.col("before")).alias("begin"), "n", "ids").mapInArrow(tidied(run, "bpe"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in the corpus's own mixture of sources."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
