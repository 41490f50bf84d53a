"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. A three-letter window is the product of its
letters' vectors, turned by two, one and no places; a document is the sum of its windows' vectors, and a language's
prototype the sum of its training documents', each of length one. The prediction is the prototype of largest cosine.
Words are lower-cased; what isn't a letter separates words and counts as one more letter.

Prototypes are learnt from at most PER_LANGUAGE documents of each language, chosen by a hash of their ids, among those
whose crc32(doc_id) mod 4 isn't HELD. Only sums of vectors come to the driver. Windows are bundled SLICE distinct ones at
a time, so memory doesn't follow the variety of a text.

Defined results: a null text, or one without letters, is `und` with score 0. Whole texts are read. The score is the
cosine, 0 if negative; ties go to the first language in order. Null languages are not learnt from; a null id is neither
learnt from nor held out. Without any training document all are `und`. Repeated rows are judged each; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, slices, small, stored, table, tidied

DIM, PER_LANGUAGE, HELD, SEED = 1024, 3_000, 2, 5
#: Documents bundled by one matrix product; letters of theirs that are taken at a time; distinct windows of a product.
GROUP, LETTERS, SLICE = 64, 1 << 18, 2048
#: Letters whose vectors are kept from group to group.
KEPT = 8192
BOUNDARY = 0


class Letters:
    """Numbers of letters, given as they come up, and the vectors made from their code points; 0 is the boundary."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.clear()

    def clear(self) -> None:
        self.number = np.full(0x110000, -1, np.int32)
        self.count = 0
        self.vectors = np.zeros((64, self.dim), np.int8)
        self._add(-1)

    def _add(self, code: int) -> int:
        if self.count == len(self.vectors):
            self.vectors = np.vstack([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.count] = np.random.default_rng((SEED, code + 1)).integers(0, 2, self.dim) * 2 - 1
        self.count += 1
        return self.count - 1

    def numbers(self, text: str) -> np.ndarray:
        """Letter numbers of a text with one boundary between words and at its ends; empty without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.number[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]).tolist():
                self.number[c] = self._add(c) if chr(c).isalpha() else BOUNDARY
            out = self.number[codes]
        if not out.any():
            return out[:0]
        out = np.concatenate([[BOUNDARY], out, [BOUNDARY]])
        return out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])]

    def windows(self, codes: np.ndarray, n: int) -> np.ndarray:
        """Vectors of windows given as a * n^2 + b * n + c."""
        v = self.vectors
        return np.roll(v[codes // (n * n)], 2, 1) * np.roll(v[codes // n % n], 1, 1) * v[codes % n]

    def add(self, out: np.ndarray, row: np.ndarray, codes: np.ndarray, n: int) -> None:
        """Adds the windows' vectors to their rows of out."""
        if n**3 <= 4_000_000:
            seen = np.flatnonzero(np.bincount(codes, minlength=n**3))
            place = np.zeros(n**3, np.int64)
            place[seen] = np.arange(len(seen))
            at = place[codes]
        else:
            seen, at = np.unique(codes, return_inverse=True)
        if len(seen) > SLICE:
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
        for low in range(0, len(seen), SLICE):
            high = min(low + SLICE, len(seen))
            a, b = np.searchsorted(at, [low, high]) if len(seen) > SLICE else (0, len(at))
            counts = np.bincount(row[a:b] * (high - low) + at[a:b] - low, minlength=len(out) * (high - low)).reshape(len(out), -1)
            out += counts.astype(np.float32) @ self.windows(seen[low:high], n).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """The vector of each text; zero without letters."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for g in range(0, len(texts), GROUP):
            if self.count > KEPT:
                self.clear()
            some = [self.numbers(t).astype(np.int64) if t else np.empty(0, np.int64) for t in texts[g : g + GROUP]]
            n = self.count
            rows = np.repeat(np.arange(len(some)), [max(0, len(x) - 2) for x in some])
            codes = np.concatenate([(x[:-2] * n + x[1:-1]) * n + x[2:] if len(x) > 2 else x[:0] for x in some])
            for at in range(0, len(codes), LETTERS):
                first = rows[at]
                part = rows[at : at + LETTERS]
                self.add(out[g + first : g + part[-1] + 1], part - first, codes[at : at + LETTERS], n)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def remainder(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 4


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, of length one."""
    with scratch(docs.sparkSession):
        return _trained(docs, per_language)


def _trained(docs: DataFrame, per_language: int) -> tuple[list[str], np.ndarray]:
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != HELD)).select("doc_id", "lang").distinct()
    # of a language's ids so many hashes are left that about 1.5 times the number wanted are ranked, whatever the input
    share = stored(ids.groupBy("lang").agg(F.count("*").alias("n")))
    h = F.xxhash64("doc_id", F.lit(SEED))
    low = ids.withColumn("h", h).join(small(share), "lang").where(F.shiftrightunsigned("h", 1) < F.least(F.lit(float(2**63)), F.lit(2.0**63 * (1.5 * per_language + 100)) / F.col("n")))
    few = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language).select("doc_id", "lang")
    rows = docs.select("doc_id", "lang", "text").join(small(stored(few)), ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(), {}
        for b in batches:
            for part in slices(b):
                v = unit(letters.bundles(part.column("text").to_pylist())).astype(np.float64)
                langs = part.column("lang").to_pylist()
                for g in set(langs):
                    sums[g] = sums.get(g, 0) + v[[i for i, x in enumerate(langs) if x == g]].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "v"])

    total: dict[str, np.ndarray] = {}
    for r in sorted(rows.mapInArrow(tidied(run), "lang string, v binary").collect()):
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["v"])
    names = sorted(x for x in total if np.any(total[x]))
    return names, unit(np.array([total[x] for x in names]).reshape(-1, DIM)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row; only the text decides."""

    letters = Letters()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = letters.bundles(b.column("text").to_pylist())
        near = unit(v) @ prototypes.T if names else np.zeros((len(v), 1))
        best = near.argmax(axis=1)
        known = v.any(axis=1) & bool(names)
        score = np.where(known, np.clip(near[np.arange(len(v)), best], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([names[i] if k else "und" for i, k in zip(best, known, strict=True)], pa.string()), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id")) == HELD, F.lit(False))
    return map_arrow(docs.select("doc_id", held.alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(docs, *train(docs))


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
