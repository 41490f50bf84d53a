"""Vector search by a tree of centroids with residual product codes, and exact search for a table of queries.

`Tree` holds vectors of length one under the leaves of a k-means tree. The tree is a table of nodes, grown level by level:
rows and children of a node meet in slices of the node, so neither a node nor the tree has to fit in one task. Every row
is filed in the lists of the two nearest leaves that a beam of two finds. A list stores, beside the ids, codes of what its
centroid leaves of each vector: a byte for each few components, the number of the nearest word of a codebook. A search
follows the tree with a beam, estimates inner products from the codes of its lists, and reads the vectors of the best
estimates only. Centroids and codebooks are fitted to bounded samples of smallest hashes; all rows are filed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Children of a node; rows of a list; rows sampled of a node; steps of k-means; beam in which rows are filed.
CHILDREN, LIST, SAMPLE, STEPS, FILED = 8, 128, 512, 12, 2
#: Components of a code's byte, words of a codebook, rows that codebooks are fitted to.
COMPONENTS, WORDS, CODED = 2, 256, 8192
#: Rows of a node that meet its children in one task; queries, and vectors, of a block; what rounding to six digits may hide.
SLICE, QUERIES, BLOCK, SLACK = 65_536, 1024, 65_536, 2e-6


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def lists_of(x: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids, from distinct rows on, each next one far from those before."""
    x = np.unique(x, axis=0)
    c = x[:1].copy()
    away = ((x - c[0]) ** 2).sum(axis=1)
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[away.argmax()]])
        away = np.minimum(away, ((x - c[-1]) ** 2).sum(axis=1))
    for _ in range(STEPS):
        of = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        for i in range(len(c)):
            if (of == i).any():
                c[i] = x[of == i].mean(axis=0)
    return c


def units(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components and of some length, as they are, in doubles."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"))


class Tree:
    """An index in a folder: nodes, lists of codes, vectors, codebooks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        shape = spark.read.parquet(f"{path}/shape").collect()[0]
        self.d, self.depth, self.rows = shape["d"], shape["depth"], shape["n"]
        self.words = [np.array(r["words"]).reshape(-1, COMPONENTS) for r in sorted(spark.read.parquet(f"{path}/words").collect(), key=lambda r: r["part"])]

    # ------------------------------------------------------------ building
    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> Tree:
        spark = rows.sparkSession
        spare = units(rows, id_col, vec_col).select(F.monotonically_increasing_id().alias("row"), "id", "v")
        spare.write.parquet(f"{path}/numbered")
        held = spark.read.parquet(f"{path}/numbered")
        d = (held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect() or [[0]])[0][0]
        held = held.where(F.size("v") == d)
        n = held.count()
        depth = max(1, int(np.ceil(np.log(max(1, n / LIST)) / np.log(CHILDREN))))
        at = held.select("row", "v", F.lit(0).cast("long").alias("node"))
        for level in range(depth):
            cls._fit(at, d, level, n).write.parquet(f"{path}/nodes/level={level}")
            nodes = spark.read.parquet(f"{path}/nodes/level={level}")
            descend(at, nodes, d, FILED, "row").write.parquet(f"{path}/at{level}")
            at = spark.read.parquet(f"{path}/at{level}")
        leaves = spark.read.parquet(f"{path}/nodes/level={depth - 1}").select("node", "centroid")
        words = cls._words(at, leaves, d)
        spark.createDataFrame([(i, w.ravel().tolist()) for i, w in enumerate(words)], "part int, words array<double>").coalesce(1).write.parquet(f"{path}/words")
        named = held.select("row", "id")
        coded = cls._coded(at, leaves, d, words).join(named, "row")
        # a list of many rows comes in slices
        sizes = at.groupBy("node").agg((F.floor((F.count("*") - 1) / SLICE) + 1).cast("int").alias("slices"))
        sizes.write.parquet(f"{path}/sizes")
        coded = coded.join(spark.read.parquet(f"{path}/sizes"), "node").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int")).drop("slices")
        coded.repartitionByRange("node", "row").sortWithinPartitions("node", "row").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/lists")
        held.select("row", "id", "v").write.parquet(f"{path}/vectors")
        spark.createDataFrame([(d, depth, n)], "d int, depth int, n long").coalesce(1).write.parquet(f"{path}/shape")
        for level in range(depth):
            _drop(spark, f"{path}/at{level}")
        _drop(spark, f"{path}/numbered")
        return cls(spark, path)

    @staticmethod
    def _fit(at: DataFrame, d: int, level: int, n: int) -> DataFrame:
        """(parent, node, centroid): children of each node, from a sample of its rows."""
        # of each node's rows those of smallest hashes, found by slices first
        h = F.xxhash64("row", F.lit(level))
        w = lambda *keys: Window.partitionBy(*keys).orderBy(h, "row")
        some = at.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(max(1, n // SLICE)))).withColumn("k", F.row_number().over(w("node", "part"))).where(F.col("k") <= SAMPLE)
        some = some.withColumn("k", F.row_number().over(w("node"))).where(F.col("k") <= SAMPLE)

        def fit(t: pa.Table) -> pa.Table:
            x = matrix(t.column("v"), d)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            c = kmeans(x, CHILDREN)
            parent = t.column("node")[0].as_py()
            return pa.table([pa.array([parent] * len(c), pa.int64()), pa.array([parent * CHILDREN + i for i in range(len(c))], pa.int64()), lists_of(c)], ["parent", "node", "centroid"])

        return some.select("node", "v").groupBy("node").applyInArrow(fit, "parent long, node long, centroid array<double>")

    @staticmethod
    def _words(at: DataFrame, leaves: DataFrame, d: int) -> list[np.ndarray]:
        """A codebook for each few components, of what centroids leave of a sample of vectors."""
        few = at.orderBy(F.xxhash64("row", "node", F.lit(99)), "row", "node").limit(CODED).join(leaves, "node").select("v", "centroid").toArrow()
        if not few.num_rows:
            return []
        v = matrix(few.column("v"), d)
        left = v / np.linalg.norm(v, axis=1, keepdims=True) - matrix(few.column("centroid"), d)
        left = np.pad(left, ((0, 0), (0, -d % COMPONENTS)))
        return [kmeans(left[:, i : i + COMPONENTS], WORDS) for i in range(0, left.shape[1], COMPONENTS)]

    @staticmethod
    def _coded(at: DataFrame, leaves: DataFrame, d: int, words: list[np.ndarray]) -> DataFrame:
        """(row, node, code) of each row in each of its lists."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = matrix(b.column("v"), d)
                left = v / np.linalg.norm(v, axis=1, keepdims=True) - matrix(b.column("centroid"), d)
                left = np.pad(left, ((0, 0), (0, -d % COMPONENTS)))
                code = np.stack([((w * w).sum(axis=1)[None] - 2 * left[:, i * COMPONENTS : (i + 1) * COMPONENTS] @ w.T).argmin(axis=1) for i, w in enumerate(words)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("node"), pa.array([x.tobytes() for x in code], pa.binary())], ["row", "node", "code"])

        return at.join(leaves, "node").select("row", "node", "v", "centroid").mapInArrow(run, "row long, node long, code binary")

    # ------------------------------------------------------------ searching
    def nodes(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes/level={level}")

    def candidates(self, queries: DataFrame, probes: int, keep: int) -> DataFrame:
        """(query, row): of each of (query, v) the `keep` rows of best estimates in the `probes` lists that the beam ends at."""
        at = queries.select("query", "v", F.lit(0).cast("long").alias("node"))
        for level in range(self.depth):
            at = descend(at, self.nodes(level), self.d, probes, "query")
        d, words = self.d, self.words

        def estimate(left: pa.Table, right: pa.Table) -> pa.Table:
            """The best estimates of a slice of a list for each of its queries."""
            names, out = ["query", "row", "guess"], [pa.table([left.column("query").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query", "row", "guess"])]
            if left.num_rows and right.num_rows:
                code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
                c, m = matrix(left.column("centroid").slice(0, 1), d)[0], min(keep, len(code))
                for s in range(0, left.num_rows, 64):
                    part = left.slice(s, 64)
                    x = matrix(part.column("v"), d)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    padded = np.pad(x, ((0, 0), (0, -d % COMPONENTS)))
                    guess = np.repeat((x @ c)[:, None], len(code), axis=1)
                    for i, w in enumerate(words):
                        guess += (padded[:, i * COMPONENTS : (i + 1) * COMPONENTS] @ w.T)[:, code[:, i]]
                    best = np.argpartition(-guess, m - 1, axis=1)[:, :m]
                    out.append(pa.table([part.column("query").take(pa.array(np.repeat(np.arange(len(x)), m))), right.column("row").take(pa.array(best.ravel())), pa.array(np.take_along_axis(guess, best, 1).ravel())], names))
            return pa.concat_tables(out)

        # the queries of a list, if many, come in groups, each of which meets each slice of the list
        busy = at.groupBy("node").agg((F.floor((F.count("*") - 1) / QUERIES) + 1).cast("int").alias("groups"))
        met = at.join(self.nodes(self.depth - 1).select("node", "centroid"), "node").join(busy, "node").join(self.spark.read.parquet(f"{self.path}/sizes"), "node")
        left = met.withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("node", "slice", "group", "query", "v", "centroid")
        right = self.spark.read.parquet(f"{self.path}/lists").join(busy, "node").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("node", "slice", "group", "row", "code")
        kind, keys = at.schema["query"].dataType.simpleString(), ("node", "slice", "group")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(estimate, f"query {kind}, row long, guess double")
        one = found.groupBy("query", "row").agg(F.max("guess").alias("guess"))  # a row may stand in two of the lists
        return one.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "row"))).where(F.col("k") <= keep).select("query", "row")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, keep: int = 200, id_col: str = "query", vec_col: str = "v") -> DataFrame:
        """(query, rank, id, score): the k rows of largest cosine among the `keep` best estimates in the `probes` nearest lists.

        queries: a table of any size; their ids are distinct.
        """
        d = self.d
        q = units(queries, id_col, vec_col).where(F.size("v") == d).select(F.col("id").alias("query"), "v")
        both = self.candidates(q, probes, keep).join(self.spark.read.parquet(f"{self.path}/vectors"), "row").join(q.withColumnRenamed("v", "q"), "query")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = matrix(b.column("v"), d), matrix(b.column("q"), d)
                cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(cos)], ["query", "id", "score"])

        kind, ids = both.schema["query"].dataType.simpleString(), both.schema["id"].dataType.simpleString()
        scored = both.select("query", "id", "v", "q").mapInArrow(exact, f"query {kind}, id {ids}, score double").withColumn("score", F.round("score", 6))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def descend(at: DataFrame, nodes: DataFrame, d: int, beam: int, key: str) -> DataFrame:
    """(key, v, node) one level down: of the children of all nodes that a row is at, the `beam` nearest.

    A node's rows come in slices, each of which meets the node's children in one task.
    """
    kind, v = (at.schema[x].dataType.simpleString() for x in (key, "v"))
    many = at.groupBy("node").agg((F.count("*") / SLICE).cast("int").alias("more"))
    dealt = at.join(F.broadcast(many.where("more > 0")), "node", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64(key), F.col("more") + 1), F.lit(0)).cast("int"))
    parts = many.select(F.col("node").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("more"))).alias("slice"))
    children = nodes.select("parent", F.col("node").alias("child"), "centroid").join(parts, "parent")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [key, "v", "child", "away"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column(key).slice(0, 0), left.column("v").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        x, c = matrix(left.column("v"), d), matrix(right.column("centroid"), d)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        away = (c * c).sum(axis=1)[None] - 2 * x @ c.T
        m = min(beam, len(c))
        best = np.argpartition(away, m - 1, axis=1)[:, :m]
        rows = pa.array(np.repeat(np.arange(len(x)), m))
        return pa.table([left.column(key).take(rows), left.column("v").take(rows), right.column("child").take(pa.array(best.ravel())), pa.array(np.take_along_axis(away, best, 1).ravel())], names)

    met = dealt.select(key, "v", "node", "slice").groupBy("node", "slice").cogroup(children.groupBy("parent", "slice")).applyInArrow(run, f"{key} {kind}, v {v}, child long, away double")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("away", "child"))
    return met.withColumn("k", rank).where(F.col("k") <= beam).select(key, "v", F.col("child").alias("node"))


def _drop(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Heap:
    """The k best of each query over blocks of vectors, and what rounding may tie with the last; its size doesn't follow the vectors."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries / np.linalg.norm(queries, axis=1, keepdims=True), k
        self.query, self.id, self.score = np.zeros(0, np.int64), pa.array([], pa.int64()), np.zeros(0)

    def add(self, ids: pa.Array, v: np.ndarray) -> None:
        length = np.linalg.norm(v, axis=1)
        cos = self.q @ (v / length[:, None]).T
        m = min(self.k, len(v))
        least = np.partition(cos, len(v) - m, axis=1)[:, len(v) - m] - SLACK
        at, col = np.nonzero(cos >= least[:, None])
        query, score = np.concatenate([self.query, at]), np.concatenate([self.score, cos[at, col]])
        held = ids.take(pa.array(col))
        held = held if not len(self.query) else pa.concat_arrays([self.id, held])
        order = np.lexsort((-score, query))
        q, s = query[order], score[order]
        first = np.searchsorted(q, q, side="left")
        last = np.minimum(first + self.k - 1, np.searchsorted(q, q, side="right") - 1)
        kept = order[s >= s[last] - SLACK]
        self.query, self.id, self.score = query[kept], held.take(pa.array(kept)), score[kept]


def knn_all(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_col: str = "query", query_vec: str = "v") -> DataFrame:
    """(query, rank, id, score): the k rows of largest cosine for each query of a table, exactly; ties to the smaller id.

    Up to QUERIES queries go to every task, which reads its vectors once and keeps k a query. More come in blocks of
    QUERIES, each of which meets each block of vectors in one task. Either way the plan is the same for any queries.
    """
    v = units(rows, id_col, vec_col)
    q = units(queries, query_col, query_vec).select(F.col("id").alias("query"), F.col("v").alias("q"))
    few = q.limit(QUERIES + 1).toArrow()
    kind, key = v.schema["id"].dataType.simpleString(), q.schema["query"].dataType.simpleString()
    schema = f"query {key}, id {kind}, score double"
    if few.num_rows <= QUERIES:
        names = few.column("query").combine_chunks()
        widths = few.column("q").combine_chunks().value_lengths().to_numpy() if few.num_rows else np.zeros(0, int)
        of = {int(d): np.flatnonzero(widths == d) for d in np.unique(widths)}
        flat = {d: matrix(few.column("q").combine_chunks().take(pa.array(i)), d) for d, i in of.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            heaps = {d: Heap(x, k) for d, x in flat.items()}
            for b in batches:
                size = b.column("v").value_lengths().to_numpy()
                for d, heap in heaps.items():
                    at = pa.array(np.flatnonzero(size == d))
                    if len(at):
                        heap.add(b.column("id").take(at), matrix(b.column("v").take(at), d))
            for d, h in heaps.items():
                if len(h.query):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(of[d][h.query])), h.id, pa.array(h.score)], ["query", "id", "score"])

        found = v.mapInArrow(run, schema)
    else:
        blocks, groups = (max(1, -(-x.count() // size)) for x, size in ((v, BLOCK), (q, QUERIES)))
        left = v.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = q.withColumn("group", F.pmod(F.xxhash64("query", "q"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def pair(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.combine_chunks(), b.combine_chunks()
            out = [pa.table([b.column("query").slice(0, 0), a.column("id").slice(0, 0), pa.array([], pa.float64())], ["query", "id", "score"])]
            if a.num_rows and b.num_rows:
                size, width = (t.column(c).combine_chunks().value_lengths().to_numpy() for t, c in ((a, "v"), (b, "q")))
                for d in np.intersect1d(size, width).tolist():
                    x, y = a.take(pa.array(np.flatnonzero(size == d))), b.take(pa.array(np.flatnonzero(width == d)))
                    for s in range(0, y.num_rows, 128):
                        h = Heap(matrix(y.column("q").slice(s, 128), d), k)
                        h.add(x.column("id").combine_chunks(), matrix(x.column("v"), d))
                        out.append(pa.table([y.column("query").slice(s, 128).take(pa.array(h.query)), h.id, pa.array(h.score)], ["query", "id", "score"]))
            return pa.concat_tables(out)

        found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(pair, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")
