"""Quality rules by an isolation forest on rule statistics.

Every document has a row of statistics (lengths, symbol and case shares, repeated words and lines). Trees split random
statistics at random values; an odd document is cut off early, so its mean path is short. The forest grows on rows of
good documents, with cuts over the span of all labelled rows; the score is 2^(-path / expected path), and the threshold is the score that parts the labelled rows best
among those that keep at least KEEP of the good ones.

Training reads all labelled documents; of rows of one id, one. Each tree grows on LEAVES rows drawn from all good ones, as
the method has it; span, quantile and threshold are exact over all labelled rows. To the driver come the rows of the trees
and sums of ranges of scores.
Where no labelled rows exist, nothing is an anomaly and only the base rules decide; where only good ones do, the
threshold is their KEEP quantile.

Defined results: a null or empty text has no words, so the base rules fail it. Whole texts are read. Repeated rows and
ids are judged each; a document labelled twice counts as bad if any label is 0. Null labels are left out. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filter_arrow, hashed_sample, map_arrow, partitions, scratch, small, stored, table

TREES, LEAVES, SEED, KEEP = 150, 256, 7, 0.998
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the forest, made from counts.
FEATURES = ["symbols", "dup_lines", "repeat_words", "upper", "marks", "same_word"]
WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def repeated_words(words: list, width: int = 3) -> int:
    """Words that lie in a window of so many words that the text holds twice or more."""
    if len(words) <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    k = len(ids) - width + 1
    code = ids[:k]
    for i in range(1, width):
        if code.max(initial=0) * len(number) >= 2**62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[i : i + k]
    order = np.argsort(code, kind="stable")
    s = code[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(k, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids), bool)
    for i in range(width):
        cover[i : i + k] |= twice
    return int(cover.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the forest's statistics of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at the six ASCII white spaces, as the rules have it
    n = len(words)
    chars = len(text.translate(WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.translate(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    some, many = max(1, chars), max(1, n)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(raw) - len(raw.translate(None, b"!\"'()+-/:;=?@[\\]^_`{}~"))
    same = max(Counter(words).values(), default=0)
    return [n, chars, symbols, dup, repeat], [symbols / some, dup / max(1, lines), repeat / many, upper / some, marks / some, same / many]


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 for a leaf), cut, left child (right is next), depth with the leaf's expected rest."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    threshold: float
    expected: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, nxt, p in zip(self.feature, self.cut, self.left, self.path, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = nxt[at] + (x[rows, np.maximum(f[at], 0)] >= c[at])
                at = np.where(inner, go, at)
            total += p[at]
        return 2.0 ** (-total / len(self.feature) / self.expected)


def _rest(n: int) -> float:
    """Expected path of a search among n."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def picks(n: int, trees: int = TREES, leaves: int = LEAVES, seed: int = SEED) -> list[np.ndarray]:
    """The numbers of each tree's rows among n."""
    r = np.random.default_rng([seed, 1])
    return [r.choice(n, min(leaves, n), replace=False) for _ in range(trees)]


def grow(rows_of: list[np.ndarray], span: np.ndarray, leaves: int = LEAVES, seed: int = SEED) -> Forest:
    """A tree of each array of rows; cuts are drawn from the whole span, so that rows unlike these are parted early."""
    r = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, leaves))))
    out = []
    for own in rows_of:
        nodes: list[list[float]] = []
        todo = [(own, 0, span[0], span[1])]
        at = 0
        while at < len(todo):
            rows, depth, low, high = todo[at]
            if depth >= limit or len(rows) <= 1 and depth > 0:
                nodes.append([-1, 0.0, 0, depth + _rest(len(rows))])
            else:
                j = int(r.integers(own.shape[1]))
                c = float(r.uniform(low[j], high[j]))
                nodes.append([j, c, len(todo), 0.0])
                side = rows[:, j] < c
                up, down = high.copy(), low.copy()
                up[j], down[j] = c, c
                todo += [(rows[side], depth + 1, low, up), (rows[~side], depth + 1, down, high)]
            at += 1
        out.append(np.array(nodes))
    size = max(map(len, out))
    flat = np.stack([np.vstack([n, np.tile([-1.0, 0, 0, 0], (size - len(n), 1))]) for n in out])
    return Forest(flat[:, :, 0].astype(np.int64), flat[:, :, 1], flat[:, :, 2].astype(np.int64), flat[:, :, 3], np.inf, max(_rest(max(map(len, rows_of))), 1e-9))


def fit(x: np.ndarray, good: np.ndarray, keep: float = KEEP) -> Forest | None:
    """A forest of the good rows, with its threshold; None without rows."""
    if not len(x):
        return None
    base = x[good] if good.any() else x
    forest = grow([base[i] for i in picks(len(base))], np.stack([x.min(0) - 1e-6, x.max(0) + 1e-6]))
    score = forest.score(x)
    if good.all() or not good.any():
        forest.threshold = float(np.quantile(score, keep)) if good.all() else float("inf")
        return forest
    floor = float(np.quantile(score[good], keep))
    cuts = np.unique(score)
    cuts = cuts[cuts >= floor]
    # of all scores the one above which most bad rows are found for the fewest good ones lost
    above = lambda rows: 1 - np.searchsorted(np.sort(rows), cuts, side="right") / len(rows)
    forest.threshold = float(cuts[np.argmax(above(score[~good]) - 4 * above(score[good]))]) if len(cuts) else floor
    return forest


def sampled(docs: DataFrame, labels: DataFrame, rows: int, column: str = "quality") -> DataFrame:
    """docs(doc_id, ..., text) with y of at most `rows` labelled documents, by a hash of their ids; y is the least label of a document.

    Of rows of one id the one of the first text is taken, so there are no more rows than ids.
    """
    one = stored(labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("y")))
    found = docs.join(F.broadcast(hashed_sample(one, "doc_id", rows, SEED)), "doc_id")
    rest = [c for c in found.columns if c != "doc_id"]
    first = found.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.coalesce("text", F.lit(""))).alias("r"))
    return first.select("doc_id", "r.*")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, y) of every labelled document: its statistics, and whether it is good; stored.

    Only rows of repeated ids are shuffled with their texts, to find the first text.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t)[1] for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("y")], ["doc_id", "x", "y"])

    one = stored(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y")))
    one = small(one.select("doc_id", (F.col("y").cast("int") > 0).alias("y")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = small(stored(texts.groupBy("doc_id").count().where("count > 1").select("doc_id")))
    first = texts.join(again, "doc_id", "left_semi").join(one, "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.join(again, "doc_id", "left_anti").join(one, "doc_id").unionByName(first.select("doc_id", "text", "y"))
    return stored(map_arrow(rows.select("doc_id", "text", "y"), run, "doc_id long, x array<double>, y boolean"))


def running(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """rows with the columns `sums` summed up to each row in the order of a key of distinct values.

    Ranges of the key are summed apart; of each only its sums come to the driver.
    """
    dealt = stored(rows.repartitionByRange(partitions(rows.sparkSession), key).withColumn("part", F.spark_partition_id()))
    whole = sorted(dealt.groupBy("part").agg(*(F.sum(c).alias(c) for c in sums)).collect())
    before = np.cumsum([[0] * len(sums), *([r[c] for c in sums] for r in whole)], axis=0)[:-1].tolist()
    known = rows.sparkSession.createDataFrame([(r["part"], *b) for r, b in zip(whole, before, strict=True)], "part int" + "".join(f", before_{c} long" for c in sums))
    upto = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.select("*", *(F.sum(c).over(upto).alias(f"upto_{c}") for c in sums)).join(F.broadcast(known), "part")
    return held.select(*rows.columns, *((F.col(f"upto_{c}") + F.col(f"before_{c}")).alias(f"upto_{c}") for c in sums))


def train(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """fit() of the statistics of all labelled documents, in the order of their ids."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = labelled(docs, labels)
        x = [F.col("x")[i] for i in range(len(FEATURES))]
        size = rows.agg(F.count("*").alias("n"), F.count_if("y").alias("good"), *(f(c).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i, c in enumerate(x))).collect()[0]
        n, good = size["n"], size["good"]
        if not n:
            return None
        span = np.array([[size[f"{side}{i}"] + by for i in range(len(FEATURES))] for side, by in (("low", -1e-6), ("high", 1e-6))])
        chosen = picks(good or n)
        wanted = spark.createDataFrame([(int(i) + 1,) for i in sorted(set(np.concatenate(chosen).tolist()))], "upto_one long")
        base = running((rows.where("y") if good else rows).select("doc_id", "x", F.lit(1).alias("one")), "doc_id", ["one"])
        held = {r["upto_one"] - 1: r["x"] for r in base.join(F.broadcast(wanted), "upto_one").select("upto_one", "x").collect()}
        forest = grow([np.array([held[i] for i in own]) for own in chosen], span)
        if not good:
            return forest

        def score(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(forest.score(b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)))), b.column("y")], ["score", "y"])

        scored = map_arrow(rows.select("x", "y"), score, "score double, y boolean")
        each = stored(running(scored.groupBy("score").agg(F.count_if("y").alias("good"), F.count_if(~F.col("y")).alias("bad")), "score", ["good", "bad"]))
        # the quantile lies between two of the good rows' scores
        at = (good - 1) * KEEP
        a, b = each.agg(*(F.min(F.when(F.col("upto_good") >= i, F.col("score"))) for i in (int(at) + 1, min(int(at) + 2, good)))).collect()[0]
        forest.threshold = floor = float(np.quantile([a, b], at - int(at)))
        if good < n:
            above = lambda c, all_: 1 - F.col(c) / F.lit(float(all_))
            best = (above("upto_bad", n - good) - 4 * above("upto_good", good))
            forest.threshold = each.where(F.col("score") >= floor).orderBy(best.desc(), "score").limit(1).collect()[0]["score"]
    return forest


def verdicts(texts: list[str | None], forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, the forest's scores and kept."""
    found = [statistics(t) for t in texts]
    base = np.array([x for x, _ in found], np.int64).reshape(-1, len(BASE))
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    if not forest:
        return base, failed, np.full(len(base), np.nan), ~failed
    score = forest.score(np.array([x for _, x in found]).reshape(-1, len(FEATURES)))
    return base, failed, score, ~failed & (score <= forest.threshold)


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts, base_failed, anomaly (the forest's score, null without a forest) and kept, a row for each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        base, failed, score, kept = verdicts(b.column("text").to_pylist(), forest)
        cols = [b.column("doc_id"), *(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score, from_pandas=True), pa.array(kept)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(narrow, run, "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, anomaly double, kept boolean")


def keep(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    return filter_arrow(docs, lambda b: verdicts(b.column("text").to_pylist(), forest)[3])


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and the forest of their labels."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_rules": op3_rules}
ORACLES: dict[str, str] = {}
