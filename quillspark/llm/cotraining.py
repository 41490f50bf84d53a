"""Quality classifier by co-training of two views.

The content view sees the words and shapes of the whole text; the metadata view sees what a page's record tells without
reading its words: source, language, and the size of the text in characters and lines. Each is a logistic regression. In each round either view labels the documents it is surest of, if sure enough,
for the other to learn from; they are looked for among all documents without a label. At the end each view is calibrated on labelled rows kept apart, and a logistic
regression over the two calibrated log odds, fitted on the same rows, gives the score of every document. If either part of
the labelled rows lacks a class, calibration uses the training rows.

Training reads at most LABELLED documents with a label, chosen by a hash of their ids. The feature vectors, of fixed length,
of all documents without one are written to a scratch table, which every round scores in tasks. To the driver come those
of labelled documents and, a round, the TAKEN surest documents of each view and class. With no label, or labels of one kind only, all
documents get that kind's share (1 where nothing is known) as their score.

Defined results: a null text is empty and has empty content features; null metadata is a value of its own. Whole texts
are read. Repeated rows and ids are scored each; a document labelled twice counts as bad if any label is 0; null labels
are left out. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filter_arrow, map_arrow, scratch, slices, small, stored, table, tidied
from .rule_forest import sampled

LABELLED, ROUNDS = 6_000, 5
#: Least calibrated probability of a pseudo-label, and most of them a round and class.
SURE, TAKEN = 0.97, 300
#: Parts in which the surest documents of all tasks are ranked before the last ranking.
MERGED = 64
#: Lengths of the feature vectors: word hashes, shapes, shape pairs, then repetition; and of the metadata.
WORDS, SHAPES, PAIRS, EXTRA, META = 256, 256, 512, 4, 96
#: The share of clean documents among the calibration rows that the cut keeps at least.
KEEP = 0.998


class Word(dict):
    """word -> (hash, shape), kept for words seen before; emptied when it grows past its bound."""

    BOUND = 100_000

    def __missing__(self, word: str) -> tuple[int, int]:
        shape, last = [], ""
        for c in word:
            k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else c
            if k != last:
                shape.append(k)
                last = k
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = out = (zlib.crc32(word.encode()) % WORDS, zlib.crc32("".join(shape[:6]).encode()) % SHAPES)
        return out


def content(text: str | None, cache: Word) -> np.ndarray:
    """Square roots of the shares of words and shapes, and the shares of repeated neighbours, words and lines."""
    words = (text or "").split()
    out = np.zeros(WORDS + SHAPES + PAIRS + EXTRA, np.float32)
    if not words:
        return out
    ids = np.array(list(map(cache.__getitem__, words)), np.int64)
    n = len(words)
    out[:WORDS] = np.sqrt(np.bincount(ids[:, 0], minlength=WORDS) / n)
    out[WORDS : WORDS + SHAPES] = np.sqrt(np.bincount(ids[:, 1], minlength=SHAPES) / n)
    pairs = (ids[:-1, 1] * 263 + ids[1:, 1]) % PAIRS
    out[WORDS + SHAPES : -EXTRA] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / max(1, n - 1))
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
    out[-EXTRA:] = [again, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2)]
    return out


def metadata(source: str | None, lang: str | None, text: str | None) -> np.ndarray:
    """Hashed source and language, and steps of length, lines and line length."""
    out = np.zeros(META, np.float32)
    text = text or ""
    lines = text.count("\n") + 1
    out[zlib.crc32(f"s{source}".encode()) % 48] = 1
    out[48 + zlib.crc32(f"l{lang}".encode()) % 12] = 1
    out[60 + min(11, int(np.log2(1 + len(text)) * 0.7))] = 1
    out[72 + min(11, int(np.log2(lines)))] = 1
    out[84 + min(11, int(np.log2(1 + len(text) / lines)))] = 1
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    w: np.ndarray
    b: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> Linear:
    """Logistic regression by accelerated gradient steps of a safe length."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x1.shape[1])
    v = w.copy()
    length = 4 / max(1e-9, float(np.mean((x1.astype(np.float64) ** 2).sum(axis=1)))) / 1.5
    for k in range(steps):
        g = x1.T @ (sigmoid(x1 @ v.astype(x1.dtype)) - y) / len(y) + penalty * np.append(v[:-1], 0)
        nxt = v - length * g
        v = nxt + k / (k + 3) * (nxt - w)
        w = nxt
    return Linear(w[:-1].astype(np.float32), float(w[-1]))


@dataclass
class Model:
    """Views, their calibrations (slope, shift), the combination and the cut; without views, a constant."""

    views: tuple[Linear, Linear] | None
    calibration: list[tuple[float, float]]
    mix: tuple[float, float, float]
    cut: float
    constant: float = 1.0
    taken: tuple[int, int] = (0, 0)

    def scores(self, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of either view and of both."""
        if self.views is None:
            same = np.full(len(c), self.constant)
            return same, same, same
        z = [a * f(x) + b for (a, b), f, x in zip(self.calibration, self.views, (c, m), strict=True)]
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.mix[0] * z[0] + self.mix[1] * z[1] + self.mix[2])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope, not negative, and shift that turn scores into log odds."""
    scale = max(1e-6, float(np.abs(z).mean()))
    f = logistic((z / scale)[:, None], y, 1e-3, 400)
    return max(0.0, float(f.w[0])) / scale, f.b


#: By view and class, the surest documents that the other view has not learnt: (key, content, metadata).
Surest = dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]]


def cotrain(content_: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_content: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, keep: float = KEEP) -> Model:
    """co_trained() with a pool of vectors at hand."""
    pool = [pool_content, pool_meta]

    def surest(views: list[Linear], odds: list[tuple[float, float]], known: list[list[int]]) -> Surest:
        out: Surest = {}
        keys = np.arange(len(pool_content))
        for (v, label), (sure, at) in sure_rows(views, odds, known, pool, keys).items():
            best = at[np.argsort(-sure, kind="stable")][:TAKEN].tolist()
            out[v, label] = [(r, pool_content[r], pool_meta[r]) for r in best]
        return out

    return co_trained(content_, meta, y, surest, rounds if len(pool_content) else 0, keep)


def sure_rows(views: list[Linear], odds: list[tuple[float, float]], known: list[list[int]], pool: list[np.ndarray], keys: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By view and class: probabilities and places of the rows it is sure of, without those that the other view has learnt (`known`, by view)."""
    out = {}
    for v in (0, 1):
        p = sigmoid(odds[v][0] * views[v](pool[v]) + odds[v][1])
        new = ~np.isin(keys, np.array(known[1 - v], np.int64))
        for label, sure in ((1, p), (0, 1 - p)):
            at = np.flatnonzero(new & (sure >= SURE))
            out[v, label] = (sure[at], at)
    return out


def co_trained(content_: np.ndarray, meta: np.ndarray, y: np.ndarray, surest: Callable[[list[Linear], list[tuple[float, float]], list[list[int]]], Surest], rounds: int = ROUNDS, keep: float = KEEP) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(None, [], (0, 0, 0), 0.5, float(y.mean()) if len(y) else 1.0)
    y = y.astype(np.float32)
    apart = np.arange(len(y)) % 4 == 3  # calibration rows
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    cal = apart if apart.any() else ~apart
    x = [content_, meta]
    # pseudo-labels, with the vector, that either view has learnt from, by key
    extra: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]
    views: list[Linear] = []
    for turn in range(rounds + 1):
        views, odds = [], []
        for v in (0, 1):
            learnt = [extra[v][r] for r in sorted(extra[v])]
            views.append(logistic(np.vstack([x[v][~apart], *(vector[None] for _, vector in learnt)]), np.concatenate([y[~apart], np.array([label for label, _ in learnt], np.float32)])))
            odds.append(platt(views[v](x[v][cal]), y[cal]))
        if turn == rounds:
            break
        new = surest(views, odds, [sorted(e) for e in extra])
        if not any(new.values()):  # nothing to learn: the views stay as they are
            break
        for (v, label), rows in new.items():
            extra[1 - v] |= {r[0]: (label, r[2 - v]) for r in rows}
    z = np.stack([a * f(v[cal]) + b for (a, b), f, v in zip(odds, views, x, strict=True)], 1)
    scale = np.maximum(1e-6, np.abs(z).mean(axis=0))
    both = logistic(z / scale, y[cal], 1e-3, 400)
    model = Model((views[0], views[1]), odds, (float(both.w[0] / scale[0]), float(both.w[1] / scale[1]), both.b), 0.5, taken=(len(extra[0]), len(extra[1])))
    # the cut: one half, or lower if that would lose more clean documents than allowed
    s = model.scores(content_[cal], meta[cal])[2]
    model.cut = min(0.5, float(np.quantile(s[y[cal] > 0], 1 - keep)))
    return model


def _packed(vector: np.ndarray) -> bytes:
    """Half floats, most of them 0, deflated: less to hold in the JVM."""
    return zlib.compress(vector.astype(np.float16).tobytes(), 1)


def _unpacked(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(zlib.decompress, rows)), np.float16).reshape(-1, width).astype(np.float32)


def features(docs: DataFrame, keep: str) -> DataFrame:
    """(content, meta) as packed vectors, with the column `keep` (int)."""
    cache = Word()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t, s, g = (b.column(x).to_pylist() for x in ("text", "source", "lang"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(keep), pa.array([_packed(content(x, cache)) for x in t], pa.binary()), pa.array([_packed(metadata(*x)) for x in zip(s, g, t, strict=True)], pa.binary())], ["doc_id", keep, "content", "meta"])

    return map_arrow(docs.select("doc_id", keep, "text", "source", "lang"), run, f"doc_id long, {keep} int, content binary, meta binary")


def _matrix(rows: list, column: str, width: int) -> np.ndarray:
    return _unpacked([r[column] for r in rows], width)


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))


def surest_of(pool: DataFrame, views: list[Linear], odds: list[tuple[float, float]], known: list[list[int]]) -> Surest:
    """The surest rows of pool(row, doc_id, content, meta): each task keeps its own TAKEN of each view and class, by ids only, then the best of all get their vectors."""
    width = WORDS + SHAPES + PAIRS + EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for b in (part for whole in batches for part in slices(whole)):
            vectors = [_unpacked(b.column(c).to_pylist(), n) for c, n in (("content", width), ("meta", META))]
            keys, ids = b.column("row").to_numpy(), b.column("doc_id").fill_null(-1).to_numpy()
            for k, (sure, at) in sure_rows(views, odds, known, vectors, keys).items():
                if len(at):
                    all_ = [np.concatenate([x, y]) for x, y in zip(best[k], (sure, ids[at], keys[at]), strict=True)] if k in best else [sure, ids[at], keys[at]]
                    order = np.lexsort((all_[2], all_[1], -all_[0]))[:TAKEN]
                    best[k] = tuple(x[order] for x in all_)
        for (v, label), (sure, ids, keys) in best.items():
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([v] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(sure.astype(np.float64)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["view", "label", "sure", "doc_id", "row"])

    tops = pool.mapInArrow(tidied(run), "view int, label int, sure double, doc_id long, row long")
    # the best of parts first, so that the last ranking is of MERGED * TAKEN rows of a kind, whatever the number of tasks
    part = Window.partitionBy("view", "label", F.pmod(F.xxhash64("row"), F.lit(MERGED))).orderBy(F.desc("sure"), "doc_id", "row")
    tops = stored(tops.withColumn("k", F.row_number().over(part)).where(F.col("k") <= TAKEN).drop("k"))
    kinds = [(v, label) for v in (0, 1) for label in (1, 0)]
    best = reduce(DataFrame.unionAll, (tops.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.desc("sure"), "doc_id", "row").limit(TAKEN) for v, label in kinds)).select("view", "label", "row").collect()
    if not best:
        return {}
    wanted = pool.sparkSession.createDataFrame([(x,) for x in sorted({r["row"] for r in best})], "row long").coalesce(1)
    found = pool.join(F.broadcast(wanted), "row", "left_semi").select("row", "content", "meta").collect()
    vectors = {r["row"]: (_matrix([r], "content", width)[0], _matrix([r], "meta", META)[0]) for r in found}
    return {(v, label): [(r["row"], *vectors[r["row"]]) for r in best if (r["view"], r["label"]) == (v, label)] for v, label in kinds}


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    with scratch(docs.sparkSession):
        return _trained(plain(docs), labels, labelled, rounds)


def _trained(docs: DataFrame, labels: DataFrame, labelled: int, rounds: int) -> Model:
    rows = features(sampled(docs, labels, labelled).withColumn("y", F.col("y").cast("int")), "y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    width = WORDS + SHAPES + PAIRS + EXTRA
    y = np.array([r["y"] > 0 for r in rows], np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: no pool is needed
        rounds = 0
    pool = None

    def surest(views: list[Linear], odds: list[tuple[float, float]], known: list[list[int]]) -> Surest:
        nonlocal pool
        if pool is None:
            known_ids = small(stored(labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()))
            free = docs.join(known_ids, "doc_id", "left_anti").withColumn("y", F.lit(-1))
            pool = stored(features(free, "y").withColumn("row", F.monotonically_increasing_id()).drop("y"))
        return surest_of(pool, views, odds, known)

    return co_trained(_matrix(rows, "content", width), _matrix(rows, "meta", META), y, surest, rounds)


def _scored(model: Model, cache: Word, text: list, source: list, lang: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, m = np.stack([content(x, cache) for x in text]), np.stack([metadata(*x) for x in zip(source, lang, text, strict=True)])
    return model.scores(c.astype(np.float16).astype(np.float32), m)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, content_score, meta_score, score, quality, kept), a row for each row: probabilities, the label, and whether it stays."""
    cache = Word()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        p = _scored(model, cache, *(b.column(x).to_pylist() for x in ("text", "source", "lang")))
        good = p[2] >= model.cut
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x.astype(np.float64)) for x in p), pa.array(good.astype(np.int32)), pa.array(good)], ["doc_id", "content_score", "meta_score", "score", "quality", "kept"])

    return map_arrow(plain(docs), run, "doc_id long, content_score double, meta_score double, score double, quality int, kept boolean")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    cache = Word()
    return filter_arrow(docs, lambda b: _scored(model, cache, *(b.column(x).to_pylist() for x in ("text", "source", "lang")))[2] >= model.cut)


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the two views trained on their labels."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_cotraining": op1_cotraining}
ORACLES: dict[str, str] = {}
