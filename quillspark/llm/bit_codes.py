"""Nearest neighbours by randomly rotated one-bit codes.

Each vector is centred, turned into a space of at least BITS dimensions by a random rotation and kept as its sign bits,
packed, with its norm and the product of its direction with its code. A query is turned likewise and rounded to PLANES
bits a dimension, kept as bit planes; then its product with a code is a sum of the set bits that planes and code have in
common. The estimate made of it errs by at most |query| * |residual| * sqrt(1/f^2 - 1) * BOUND / sqrt(bits - 1), f being the
product of direction and code, and by BOUND deviations of what rounding the query lost. In each block the PROBES vectors
of best estimate are scored on the original vectors in double precision; the k-th best of them is a floor, and every
vector whose upper bound reaches the floor is scored likewise. So a block's answer is exact but for a bound that fails.

Defined results: a vector that is null, zero, of another length than most of the candidates (the smaller length if tied)
or holds null or non-finite components takes no part as query or candidate. Ties go to the smaller id, repeated ids count
as candidates each (a query's own id never). Repeated query rows are one query; rows of one id with different vectors are
ranked each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_sample, stored, table, tidied

#: Half-width of the error bound in standard deviations of the code's error.
BOUND = 4.0
#: Length of the codes, bits of a query's dimension, and vectors scored first to set the floor.
BITS, PLANES, PROBES = 256, 4, 64
#: Vectors of a candidate block and queries of a query block; a task holds one of each.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Vectors, chosen by a hash of their ids, whose mean is the centre; any centre gives the same results.
CENTRED = 2048
SEED = 20_231


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random matrix of d orthonormal columns and at least max(BITS, d) rows, a multiple of 64."""
    rows = -(-max(BITS, d) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((rows, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that may take part, as floats if they are such, else as doubles."""
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    huge = F.lit(float("inf"))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < huge) & (x > -huge)) & F.exists("v", lambda x: x != 0)
    )


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(vectors: DataFrame, d: int, centre: list[float], blocks: int) -> DataFrame:
    """The index: (block, id, v, code, norm, f), a row for each vector; rows are dealt to blocks in turn."""
    p, c = rotation(d), np.array(centre)
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() * 7919
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), d)
            norm = np.linalg.norm(v - c, axis=1)
            unit = (v - c) / np.where(norm > 0, norm, 1)[:, None] @ p.T
            f = np.abs(unit).sum(axis=1) / np.sqrt(len(p))
            block = ((at + np.arange(len(v))) % blocks).astype(np.int32)
            at += len(v)
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column("id"), b.column("v"), pa.array([x.tobytes() for x in _words(unit >= 0)], pa.binary()), pa.array(norm), pa.array(f)], ["block", "id", "v", "code", "norm", "f"])

    return vectors.mapInArrow(tidied(run), f"block int, id long, v {kind}, code binary, norm double, f double")


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component to the last."""
    products = np.ascontiguousarray((q * v).T)
    out = np.zeros(len(q))
    for row in products:
        out += row
    return out


def _best(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: highest score, then smallest id."""
    order = np.lexsort((ids, -score, rows))
    r = rows[order]
    first = np.searchsorted(r, r, side="left")
    return order[np.arange(len(r)) - first < k]


def _score(rows: np.ndarray, at: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    score = np.empty(len(rows))
    for s in range(0, len(rows), 2048):  # in the processor's cache
        score[s : s + 2048] = _exact(q[rows[s : s + 2048]], v[at[s : s + 2048]])
    return score


def _products(q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products of turned queries with codes, given as words by column, of signs; and the length of what rounding lost of each query."""
    low = q.min(axis=1, keepdims=True)
    step = np.maximum((q.max(axis=1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
    level = np.rint((q - low) / step).astype(np.uint8)
    lost = np.linalg.norm(q - low - step * level, axis=1)
    common = np.zeros((len(q), codes.shape[1]), np.uint16)
    for j in range(PLANES):
        for word, plane in zip(codes, _words(level >> j & 1).T, strict=True):
            common += np.bitwise_count(word[None, :] & plane[:, None]).astype(np.uint16) << np.uint16(j)
    ones = np.bitwise_count(codes).sum(axis=0, dtype=np.int64)
    out = common.astype(np.float32) * (2 * step).astype(np.float32)
    out += (2 * low).astype(np.float32) * ones.astype(np.float32)
    out -= (step * level.sum(axis=1, keepdims=True, dtype=np.int64) + q.shape[1] * low).astype(np.float32)
    return out, lost


def _search(qid: np.ndarray, q: np.ndarray, index: dict, c: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of one candidate block for some queries: (query place, candidate place, score)."""
    bits, n = len(p), len(index["id"])
    estimate, lost = _products(q @ p.T, index["codes"])
    f = np.maximum(index["f"], 1e-9)
    scale = index["norm"] / f / np.sqrt(bits)
    estimate *= scale.astype(np.float32)
    estimate += (q @ c)[:, None].astype(np.float32)
    for row, col in zip(*np.nonzero(np.isin(qid, index["id"])[:, None] & (qid[:, None] == index["id"])), strict=True):
        estimate[row, col] = -np.inf
    floor = np.full(len(q), -np.inf)
    if n > k + PROBES:
        probes = np.argpartition(estimate, n - PROBES, axis=1)[:, n - PROBES :]
        exact = _score(np.repeat(np.arange(len(q)), PROBES), probes.ravel(), q, index["v"]).reshape(len(q), PROBES)
        exact[np.take_along_axis(estimate, probes, 1) == -np.inf] = -np.inf
        floor = np.sort(exact, axis=1)[:, -k] if k <= PROBES else floor
    # the bounds, and what float32 may lose
    width = index["norm"] * np.sqrt(np.maximum(0, 1 / f**2 - 1)) * BOUND / np.sqrt(bits - 1)
    spare = 1e-5 * (1 + index["norm"] + np.linalg.norm(c))
    size = np.linalg.norm(q, axis=1)
    upper = np.multiply.outer(size, width + spare).astype(np.float32)
    upper += np.multiply.outer(BOUND * lost, scale).astype(np.float32)
    upper += estimate
    rows, at = np.nonzero((upper >= floor[:, None].astype(np.float32)) & (estimate > -np.inf))
    score = _score(rows, at, q, index["v"])
    keep = _best(rows, index["id"][at], score, k)
    return rows[keep], at[keep], score[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query its k candidates of largest inner product.

    Candidates lie in blocks of about BLOCK rows. Each block of queries meets each block of candidates in a task of its
    own, whose memory is that of the two blocks; k rows a query and block go on to the last ranking. The vectors go with
    the codes, since over all queries of a block nearly every vector is one that some query scores.
    """
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    d = lengths[0]["d"]
    rows = stored(rows.where(F.size("v") == d), lasting=True)
    n = rows.count()
    few = sorted(hashed_sample(rows.groupBy("id").agg(F.min("v").alias("v")), "id", CENTRED, SEED).collect())
    centre = np.mean([r["v"] for r in few], axis=0).tolist()
    blocks = max(1, -(-n // BLOCK))
    index = encode(rows, d, centre, blocks)
    kind = rows.schema["v"].dataType.simpleString()
    asked = usable(queries, id_col, vec_col).where(F.size("v") == d).select("id", F.col("v").cast(kind).alias("v"))
    asked = stored(asked.distinct().withColumn("query", F.xxhash64("id", "v")), lasting=True)
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("group", F.pmod("query", F.lit(groups)).cast("int"))
    none = F.lit(None)
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("query", none.cast("long"))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select("block", "id", "v", none.cast("binary").alias("code"), none.cast("double").alias("norm"), none.cast("double").alias("f"), "group", "query")
    both = left.unionByName(right).withColumn("cell", F.col("group").cast("long") * F.lit(blocks) + F.col("block"))
    p, c = rotation(d), np.array(centre)

    def cell(t: pa.Table) -> pa.Table:
        asks_ = t.column("code").is_null()
        cand, asks = t.filter(pc.invert(asks_)), t.filter(asks_)
        if not cand.num_rows or not asks.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        index = {x: cand.column(x).to_numpy() for x in ("id", "norm", "f")}
        index["v"] = _matrix(cand.column("v").combine_chunks(), d)
        index["codes"] = np.ascontiguousarray(np.frombuffer(b"".join(cand.column("code").to_pylist()), np.uint64).reshape(cand.num_rows, -1).T)
        key, qid, q = asks.column("query").to_numpy(), asks.column("id").to_numpy(), _matrix(asks.column("v").combine_chunks(), d)
        out = []
        for s in range(0, len(q), 64):
            r, at, score = _search(qid[s : s + 64], q[s : s + 64], index, c, p, k)
            out.append((key[s + r], qid[s + r], index["id"][at], score))
        return pa.table(dict(zip(("query", "query_id", "id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    found = both.groupBy("cell").applyInArrow(cell, "query long, query_id long, id long, score double")
    # a query's partial answers: k rows a block, ranked once more
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20, among all other vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = nearest(v, v.where(F.col("vec_id") % 20 == 0), 20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op4_nearest": op4_nearest}
ORACLES = {"op4_nearest": SQL}
