"""Centroid clustering with Yinyang bounds.

Vectors become integers and are written once with their state: cluster, upper bound of the distance to its centroid, and
for each group of centroids a lower bound of the distance to every other centroid of the group. The centroids are
clustered into groups once, at the start. When centroids have moved, a vector's upper bound grows by its centroid's way,
each lower bound shrinks by the longest way within its group. A vector whose upper bound lies below all lower bounds stays
(global filter, first with the old upper bound and then with the exact distance); else the groups whose lower bound is
not above it are scanned exactly (group filter), the others keep their bounds. Bounds are distances in double precision,
widened by more than they can lose; whatever they can't tell is told by squared distances in exact integers, ties
included, so the result is that of full scans. Centroids are exact integer means. A round is a pass over the table that
writes it anew with its states, and an aggregation of the rows that changed cluster; the driver holds centroids only.

Defined results: rows whose vector is null, of another length, or holds null or non-finite components take no part.
Repeated rows count each. A null id is hashed as an empty string; initial centroids of equal hashes go by their
components. With fewer vectors than clusters there are as many clusters as vectors; a cluster without vectors keeps its
centroid. An empty table gives no rows. A component beyond 2^27 after scaling is an error, as distances would not fit
64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, map_arrow, scratch, scratch_path, small_batches, table, tidied

#: Components of a vector, what they are multiplied with, clusters, rounds, seed of the initial centroids.
DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Centroids of a group, rounds in which groups are found.
GROUP, GROUP_ROUNDS = 4, 5
#: Largest component; what a bound in double precision may lose, as a share of it; vectors unpacked at a time.
LARGEST, LOSS, ROWS = 1 << 27, 1e-9, 4096
STATE = "id long, v array<int>, cluster int, was int, upper double, lower array<double>, distance long, scanned int"


def usable(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that take part, as integers."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fits = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    too_large = F.exists(whole, lambda c: F.abs(c) > F.lit(LARGEST))
    checked = F.when(too_large, F.raise_error(F.lit("a vector's components are too large for distances of 64 bits"))).otherwise(F.transform(whole, lambda c: c.cast("int")))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), checked.alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in rows.orderBy(h, "v").limit(clusters).select("v").collect()], np.int64)


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid, by k-means over the centroids; groups are numbered without gaps."""
    k = len(centroids)
    groups = max(1, k // GROUP)
    middle = centroids[:: max(1, k // groups)][:groups].astype(np.float64)
    for _ in range(GROUP_ROUNDS):
        of = ((centroids[:, None].astype(np.float64) - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                middle[g] = centroids[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of v from one centroid, or from each row's own."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Round:
    """What one pass does with a block of vectors and their states."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None):
        self.c, self.group, self.moved, self.groups = centroids, group, moved, int(group.max()) + 1
        self.members = [np.flatnonzero(group == g) for g in range(self.groups)]
        if moved is not None:
            self.way = np.array([moved[m].max() for m in self.members])

    def scan(self, v: np.ndarray, rows: list[np.ndarray], cluster: np.ndarray, best: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Scans group g for the rows rows[g] with a known squared distance `best` to `cluster`; returns how many distances were taken of each row.

        A scanned group's lower bound is its least distance but for the vector's own centroid, wherever that ends up.
        """
        taken = np.zeros(len(v), np.int64)
        found, own = [], cluster.copy()  # own: the centroid of before, whose distance is known
        for g, at in enumerate(rows):
            if not len(at):
                continue
            d = np.full((len(at), len(self.members[g])), np.iinfo(np.int64).max)
            for j, m in enumerate(self.members[g]):
                there = own[at] != m
                d[there, j] = distances(v[at[there]], self.c[m])
                d[~there, j] = best[at[~there]]
                taken[at] += there
            found.append((g, at, d))
        start = best.copy()
        for g, at, d in found:
            for j, m in enumerate(self.members[g]):
                less = (d[:, j] < best[at]) | ((d[:, j] == best[at]) & (m < cluster[at]))
                cluster[at[less]], best[at[less]] = m, d[less, j]
        for g, at, d in found:
            others = np.where(self.members[g][None] == cluster[at][:, None], np.iinfo(np.int64).max, d)
            least = others.min(axis=1)
            lower[at, g] = np.where(least == np.iinfo(np.int64).max, np.inf, np.sqrt(least.astype(np.float64)) * (1 - LOSS))
        # the centroid of before is now one of the others of its own group, which may not have been scanned
        left = np.flatnonzero(own != cluster)
        left = left[own[left] >= 0]
        np.minimum.at(lower, (left, self.group[own[left]]), np.sqrt(start[left].astype(np.float64)) * (1 - LOSS))
        return taken

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(v)
        cluster, best, lower = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), np.full((n, self.groups), np.inf)
        taken = self.scan(v, [np.arange(n)] * self.groups, cluster, best, lower)
        return cluster, np.sqrt(best.astype(np.float64)) * (1 + LOSS), lower, taken

    def next(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lower = np.maximum(0, lower - self.way * (1 + LOSS)) * (1 - LOSS)
        upper = (upper + self.moved[cluster] * (1 + LOSS)) * (1 + LOSS)
        least = lower.min(axis=1)
        taken = np.zeros(len(v), np.int64)
        open_ = np.flatnonzero(upper >= least)
        if len(open_):  # with the exact distance
            best = distances(v[open_], self.c[cluster[open_]])
            upper[open_] = np.sqrt(best.astype(np.float64)) * (1 + LOSS)
            taken[open_] += 1
            still = upper[open_] >= least[open_]
            open_, best = open_[still], best[still]
        if len(open_):
            of, low = cluster[open_].copy(), lower[open_]
            rows = [np.flatnonzero(upper[open_] >= low[:, g]) for g in range(self.groups)]
            taken[open_] += self.scan(v[open_], rows, of, best, low)
            cluster[open_], lower[open_], upper[open_] = of, low, np.sqrt(best.astype(np.float64)) * (1 + LOSS)
        return cluster, upper, lower, taken


def flat(column: pa.Array, kind, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def passed(rows: DataFrame, step: Round, dim: int, last: bool) -> DataFrame:
    """rows with the state after a round; `last`: with exact squared distances."""
    first = step.moved is None

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            v = flat(b.column("v"), np.int32, dim)
            was = np.full(len(v), -1) if first else b.column("cluster").to_numpy().astype(np.int64)
            if first:
                cluster, upper, lower, taken = step.first(v)
            else:
                cluster, upper, lower, taken = step.next(v, was.copy(), b.column("upper").to_numpy().copy(), flat(b.column("lower"), np.float64, step.groups))
            d = pa.array(distances(v, step.c[cluster]) if last else np.zeros(len(v), np.int64))
            scanned = taken + (0 if first else b.column("scanned").to_numpy())
            lows = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * step.groups), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), lows, d, pa.array(scanned.astype(np.int32))], [x.split()[0] for x in STATE.split(", ")])

    return map_arrow(rows, run, STATE)


def changes(rows: DataFrame, dim: int) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """What rows that changed cluster add to, and take from, the counts and sums of clusters.

    A task sums its rows before anything is shuffled, so it sends a row a cluster whatever it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            v = flat(b.column("v"), np.int64, dim)
            for column, sign in (("cluster", 1), ("was", -1)):
                of = b.column(column).to_numpy()
                for k in np.unique(of[of >= 0]).tolist():
                    at = of == k
                    counts[k] = counts.get(k, 0) + sign * int(at.sum())
                    sums[k] = sums.get(k, 0) + sign * v[at].sum(axis=0)
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    per_task = rows.where("cluster <> was").select("v", "cluster", "was").mapInArrow(tidied(run), "cluster int, n long, total array<long>")
    whole = per_task.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i))).alias(f"c{i}") for i in range(dim))).collect()
    return {r["cluster"]: r["n"] for r in whole}, {r["cluster"]: np.array([r[f"c{i}"] for i in range(dim)], np.int64) for r in whole}


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, scanned) of each vector that takes part, and the final centroids.

    distance: squared; scanned: how many distances were computed for the vector in all rounds.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    names = "id", "cluster", "distance", "scanned"
    with scratch(spark):
        rows = usable(vectors, id_col, vec_col, dim, scale)
        centroids = first_centroids(rows, clusters, seed)
        if not len(centroids):
            return spark.createDataFrame([], "id long, cluster int, distance long, scanned int"), centroids
        group, moved, before = grouped(centroids), None, None
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for i in range(rounds + 1):
            path = scratch_path(spark, lasting=i == rounds)
            out = passed(rows, Round(centroids, group, moved), dim, i == rounds)
            (out.select(*names) if i == rounds else out).write.parquet(path)
            rows = spark.read.parquet(path)
            if before:
                delete(spark, before)
            before = path
            if i == rounds:
                break
            more, totals = changes(rows, dim)
            for k in more:
                counts[k] += more[k]
                sums[k] += totals[k]
            new = np.where(counts[:, None] > 0, np.floor_divide(sums, np.maximum(counts, 1)[:, None]), centroids)
            moved = np.sqrt(distances(new, centroids).astype(np.float64))
            centroids = new
        return rows, centroids


def digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, the clusters' inertia and their centroids' digests."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    listed = [(k, each.get(k, 0), sum(each.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    found = spark.createDataFrame(listed, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string").coalesce(1)
    return rows.join(F.broadcast(found), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_DISTANCE = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"


def _sql() -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INTEGER) AS k, v AS c FROM v ORDER BY k LIMIT {CLUSTERS})"]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS (SELECT v.row, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, arg_min(c.k, ({_DISTANCE}, c.k)) AS k, min({_DISTANCE}) AS d FROM v, c{i} c GROUP BY v.row)")
        if i < ROUNDS:
            steps.append(f"u{i} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS i FROM a{i}) GROUP BY k, i)")
            steps.append(f"m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM u{i} GROUP BY k)")
            steps.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return "WITH " + ",\n".join(f"{s.split(' AS ', 1)[0]} AS MATERIALIZED {s.split(' AS ', 1)[1]}" for s in steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c USING (k)"""


QUERIES = {"op12_centroids": op12_centroids}
ORACLES = {"op12_centroids": _sql()}
