"""Embedding and vector search."""

from __future__ import annotations

import hashlib
import math
import re
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Turns texts into vectors of one length; a remote model fits behind it."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)


def lowered(text: str) -> str:
    """Lower case letter by letter, as SQL has it: a sigma that ends a word and a dotted I become one plain letter."""
    return text.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower()


class HashEmbedder:
    """Deterministic, offline: signed hashed words, of length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w, n in Counter(re.findall(r"\w+", lowered(t))).items():
                h = _word_hash(w)
                v[h % self.dim] += n if h >> 31 else -n
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else v)
        return out


def embed(docs: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding", batch: int = 50) -> DataFrame:
    """docs with vectors of a text column, embedded in batches of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embedder.embed([x or "" for x in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embed_into(docs: DataFrame, embedder: Embedder, path: str, text_col: str = "text", out: str = "embedding", batch: int = 50, round_rows: int = 10_000, per_minute: float | None = None) -> DataFrame:
    """docs with vectors of a text column, by way of a store below path that keeps what has been embedded.

    The store holds a vector for each digest of a text. Texts that it lacks are written once below path, in files that are
    dealt to rounds of at most `round_rows` and deleted at the end, so a round reads its own texts only; a round is committed
    as a whole before the next begins. If the embedder fails, a later call embeds only what no committed round holds; equal
    texts are embedded once. per_minute: calls of the embedder, of `batch` texts at most, that all tasks together may make
    in a minute; each of the tasks that run side by side has its share and waits.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    todo = texts.dropDuplicates(["digest"]).join(stored_vectors(spark, path).select("digest"), "digest", "left_anti")
    cores = spark.sparkContext.defaultParallelism
    # at most as many tasks as share the budget
    tasks = max(1, min(cores, -(-round_rows // batch)))
    folder, schema = f"{path}/todo-{uuid.uuid4().hex}", "digest string, text string"
    try:
        todo.select("digest", "text").write.option("maxRecordsPerFile", max(1, round_rows // tasks)).parquet(folder)
        files = spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).count().orderBy("file").collect()
        for names in _rounds([(r["file"], r["count"]) for r in files], round_rows):
            rows = spark.read.schema(schema).parquet(*[f"{folder}/{x}" for x in names])
            # any round but the last has a file for each task
            rows = rows.coalesce(tasks) if len(names) >= tasks else rows.repartition(tasks, "digest")
            wait = 60 * min(cores, rows.rdd.getNumPartitions()) / per_minute if per_minute else 0.0
            made = embed(rows, _Paced(embedder, wait) if wait else embedder, "text", "embedding", batch)
            made.select("digest", "embedding").write.mode("append").parquet(f"{path}/vectors")
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    found = stored_vectors(spark, path).select(F.col("digest").alias("_digest"), F.col("embedding").alias(out))
    named = docs.withColumn("_digest", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    return named.join(found, "_digest", "left").drop("_digest")


def _rounds(files: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files of some rows each, dealt in their order to rounds of at most `most` rows, or of one file."""
    out, held = [], most
    for name, n in files:
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += n
    return out


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(digest, embedding) that a store holds; none for a new one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    schema = "digest string, embedding array<float>"
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/vectors")


class _Paced:
    """An embedder that waits between calls, in a task of its own."""

    def __init__(self, inner: Embedder, wait: float):
        self.inner, self.wait, self.dim, self.last = inner, wait, inner.dim, 0.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        left = self.last + self.wait - time.monotonic()
        if self.last and left > 0:
            time.sleep(left)
        self.last = time.monotonic()
        return self.inner.embed(texts)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df has not."""
    while name in df.columns:
        name += "_"
    return name


def result_id(metadata_id: Column, row_id: Column) -> Column:
    """The id of a result: its metadata's, if there is one, else the store's."""
    return F.coalesce(F.nullif(metadata_id, F.lit("")), row_id)


def _doubles(v: Column | list[float]) -> Column:
    if isinstance(v, Column):
        return F.transform(v, lambda x: x.cast("double"))
    return F.lit([float(x) for x in v])


def dot(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | list[float], b: Column | list[float]) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a: Column | list[float], b: Column | list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def knn(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, score) of the k most similar rows by cosine; the filter runs before any vector is read."""
    rows = rows.where(where) if where is not None else rows
    return rows.select(F.col(id_col).alias("id"), F.round(cosine(F.col(vec_col), query), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def knn_l2(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.round(l2(F.col(vec_col), query), 6).alias("distance")).orderBy("distance", "id").limit(k)


class InvertedFile:
    """Coarse lists: rows filed under the nearest of some centroids; a query reads the lists that can hold its answer.

    Centroids are fitted by k-means of directions to at most SAMPLE rows a list, chosen by a hash. Each list's widest angle
    to its centroid is taken over all rows. A query reads its nearest lists first; then every other list that, by the
    triangle inequality of angles, may hold a row as near as the last one found. So the result is that of knn() over all
    rows, wherever the centroids lie; lists are left out only where the vectors form groups. With a path, rows are written
    once in a folder a list, with the centroids, and a query reads the folders of its lists; `open` finds them again.

    filters: columns that searches filter by. For each value a list holds, its rows are counted and their nearest and
    widest angle kept, so that a filtered search (`knn_where`) leaves out lists without the value and lists whose rows of
    it are too far or lie in a ring that the query is away from.
    """

    SAMPLE, STEPS = 64, 10
    #: Scores are rounded to six digits before they are ranked: a list within this of the last score is read.
    SLACK = 2e-6
    SUMMARY = "column string, value string, list int, n long, far double, near double"

    def __init__(self, rows: DataFrame, lists: int, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None, filters: tuple[str, ...] = ()):
        self.id_col, self.vec_col, self.filters = id_col, vec_col, filters
        self.all = rows
        #: Lists that the last filtered search read.
        self.last_read: list[int] = []
        few = rows.select(vec_col).where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(lists * self.SAMPLE).collect()
        self.centroids = self.fitted([[float(x) for x in r[0]] for r in few], lists)
        self.summaries = rows.sparkSession.createDataFrame([], self.SUMMARY)
        if not self.centroids:
            self.rows, self.widest = rows.withColumn("list", F.lit(0)), {}
            if path:
                self._write(path)
            return
        cos = spare(rows, "cos")
        filed = self.filed(rows, cos)
        self.rows = filed.drop(cos)
        widest = filed.groupBy("list").agg(F.min(F.coalesce(F.nanvl(cos, F.lit(-1.0)), F.lit(-1.0))).alias("cos")).collect()
        self.widest = {r["list"]: self.angle(r["cos"]) for r in widest}
        for c in filters:
            known = filed.where(F.col(c).isNotNull()).withColumn(cos, F.coalesce(F.nanvl(cos, F.lit(-1.0)), F.lit(-1.0)))
            # the nearest angle of a row without a direction is none, so its value's ring is the whole list
            summary = known.groupBy(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "list").agg(F.count("*").alias("n"), F.min(cos).alias("far"), F.max(F.when(F.col(cos) > -1, F.col(cos)).otherwise(1.0)).alias("near"))
            self.summaries = self.summaries.unionByName(summary)
        if path:
            self._write(path)

    def filed(self, rows: DataFrame, cos: str) -> DataFrame:
        """rows with their list and the cosine to its centroid; what has no direction is in list 0, without a cosine."""
        c, vec = np.array(self.centroids), self.vec_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists, near = np.zeros(b.num_rows, np.int32), np.full(b.num_rows, np.nan)
                for i, v in enumerate(b.column(vec).to_pylist()):
                    if v is not None and len(v) == c.shape[1] and None not in v and any(v):
                        x = np.array(v, np.float64)
                        each = c @ x / np.linalg.norm(x)
                        lists[i] = each.argmax()
                        near[i] = each[lists[i]]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists), pa.array(near, from_pandas=True)], [*b.schema.names, "list", cos])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField(cos, T.DoubleType())]))

    def _write(self, path: str) -> None:
        spark = self.rows.sparkSession
        # a list may be large: its rows go to as many files as a part of each task's rows needs
        out = self.rows.write.mode("overwrite")
        (out.partitionBy("list") if self.centroids else out).parquet(f"{path}/rows")  # a partitioned table without rows has no schema
        listed = [(i, c, self.widest.get(i)) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(listed, "list int, centroid array<double>, widest double").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        self.summaries.coalesce(1).write.mode("overwrite").parquet(f"{path}/summaries")
        self._read(spark, path)

    def _read(self, spark: SparkSession, path: str) -> None:
        kept = sorted(spark.read.parquet(f"{path}/lists").collect())
        self.centroids, self.widest = [r["centroid"] for r in kept], {r["list"]: r["widest"] for r in kept if r["widest"] is not None}
        self.rows, self.summaries = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/summaries")
        self.all = self.rows

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> InvertedFile:
        out = cls.__new__(cls)
        out.id_col, out.vec_col, out.last_read = id_col, vec_col, []
        out._read(spark, path)
        return out

    def knn_where(self, query: list[float], k: int, column: str, values: list, probes: int = 1) -> DataFrame:
        """What knn() over the rows with one of some values gives.

        Lists are ordered by the most that a row of these values can score there, and read, `probes` first and then twice
        as many at each step, until k rows are found that no list left can surpass.
        """
        spark = self.rows.sparkSession
        where = F.col(column).isin(values)
        said = self.summaries.where((F.col("column") == column) & F.col("value").isin([str(v) for v in values]))
        held = said.groupBy("list").agg(F.min("far").alias("far"), F.max("near").alias("near")).collect()
        length = math.sqrt(sum(x * x for x in query))
        most = []
        for r in held:
            away = self.angle(sum(a * b for a, b in zip(self.centroids[r["list"]], query, strict=True)) / length)
            most.append((math.cos(max(0.0, away - self.angle(r["far"]), self.angle(r["near"]) - away)), r["list"]))
        most.sort(key=lambda x: (-x[0], x[1]))
        found: list[tuple] = []
        self.last_read, at = [], 0
        schema = f"id {self.rows.schema[self.id_col].dataType.simpleString()}, score double"
        while at < len(most) and k > 0:
            if len(found) == k and most[at][0] < found[-1][1] - self.SLACK:
                break
            take = [i for _, i in most[at : at + max(probes, at)]]
            at += len(take)
            self.last_read += take
            found += [tuple(r) for r in knn(self.rows, query, k, self.id_col, self.vec_col, F.col("list").isin(take) & where).collect() if r["score"] is not None]
            found = sorted(found, key=lambda x: (-x[1], x[0]))[:k]
        return spark.createDataFrame(found, schema).coalesce(1)

    @staticmethod
    def angle(cos: float) -> float:
        return math.acos(max(-1.0, min(1.0, cos)))

    @classmethod
    def fitted(cls, sample: list[list[float]], lists: int) -> list[list[float]]:
        """At most so many centroids of length one, from distinct directions of the sample on."""
        x = np.array([v for v in sample if any(v)], np.float64)
        if not len(x):
            return []
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        first = np.sort(np.unique(x.round(9), axis=0, return_index=True)[1])[:lists]
        c = x[first]
        for _ in range(cls.STEPS):
            of = (x @ c.T).argmax(axis=1)
            for i in range(len(c)):
                mean = x[of == i].sum(axis=0)
                if np.linalg.norm(mean) > 1e-9:
                    c[i] = mean / np.linalg.norm(mean)
        return c.tolist()

    def lists_of(self, query: list[float], k: int, probes: int) -> list[int]:
        """The lists that a query reads: its nearest ones, and those that may hold a row as near as the k-th found there."""
        length = math.sqrt(sum(x * x for x in query))
        away = [self.angle(sum(a * b for a, b in zip(c, query, strict=True)) / length) for c in self.centroids]
        order = sorted(self.widest, key=lambda i: (away[i], i))
        found = knn(self.rows, query, k, self.id_col, self.vec_col, F.col("list").isin(order[:probes])).collect()
        if len(found) < k or found[-1]["score"] is None:
            return order
        least = found[-1]["score"] - self.SLACK
        return order[:probes] + [i for i in order[probes:] if not math.cos(max(0.0, away[i] - self.widest[i])) < least]

    def knn(self, query: list[float], k: int, probes: int) -> DataFrame:
        """What knn() over all rows gives; `probes` lists are read first."""
        lists = self.lists_of(query, k, probes) if k and self.centroids else []
        if len(lists) == len(self.widest):
            return knn(self.all, query, k, self.id_col, self.vec_col)
        return knn(self.rows, query, k, self.id_col, self.vec_col, F.col("list").isin(lists))


def top_per(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = spare(rows, "rank")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k).drop(rank)
