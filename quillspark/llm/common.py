"""What the operators share: scratch tables, Arrow helpers, hashing and word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Spark sends at a time, and those that an operator unpacks at a time (one row at least).
ARROW_ROWS, ARROW_BYTES, BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20, 512, 4 << 20
#: Rows, or numbers of a table, that may be broadcast or gathered on the driver when a bound is proven.
SMALL_ROWS = 1_000_000
#: Rows of one key above which a join gives the key to all tasks.
HOT_ROWS = 10_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ARROW_ROWS and ARROW_BYTES, since a row may hold a whole text or packed keys."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; if that is unset, which only a local master may leave, below a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillspark/{uuid.uuid4().hex}"


#: Scratch folders of the scopes that are open in this thread (or task of an event loop), the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch scopes", default=())


def delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables stored inside are deleted at the end, but for lasting ones, which belong to the scope around, if any.

    Scopes are kept by thread, so queries that run side by side in one session don't touch each other's tables.
    """
    around = _OPEN.set((*_OPEN.get(), []))
    try:
        yield
    finally:
        mine = _OPEN.get()[-1]
        _OPEN.reset(around)
        for name in mine:
            delete(spark, name)
        free_memory()


def scratch_path(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder that the open scope deletes at its end; lasting: the scope around it."""
    path = scratch_dir(spark)
    scopes = _OPEN.get()[:-1] if lasting else _OPEN.get()
    if scopes:
        scopes[-1].append(path)
    return path


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The same rows, written to the shared scratch folder and read back: lineage is cut and a lost executor costs no rerun.

    lasting: the table outlives the scope it is made in, since a plan that is returned reads it.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage; Spark's cleaner then deletes shuffle files that no plan refers to any more, which it would else find late."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        gc.collect()
        jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """A stored table of a few columns of numbers, broadcast if it has at most SMALL_ROWS values; else joins shuffle it."""
    return F.broadcast(df) if df.count() * len(df.columns) <= SMALL_ROWS else df


def joined(rows: DataFrame, few: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows LEFT JOIN few, a stored table of distinct keys with the number `n` of rows of each key.

    A table of at most a quarter of SMALL_ROWS is broadcast. Else this holds for its keys of more than HOT_ROWS rows, of
    which there are at most rows / HOT_ROWS; so no task gets all rows of a key. The other keys are shuffled.
    """
    if few.count() <= SMALL_ROWS // 4:
        return rows.join(F.broadcast(few.drop(n)), keys, "left")
    wide = few.where(F.col(n) > HOT_ROWS).drop(n)
    if not 0 < wide.count() <= SMALL_ROWS:
        return rows.join(few.drop(n), keys, "left")
    wide = F.broadcast(wide)
    rest = rows.join(wide.select(keys), keys, "left_anti").join(few.where(F.col(n) <= HOT_ROWS).drop(n), keys, "left")
    return rows.join(wide, keys).unionByName(rest)


def hashed_sample(rows: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """At most n rows, those of smallest hash of a column of distinct values; hashes above what n needs are left out first, so few rows meet in one task."""
    total = rows.count()
    h = F.xxhash64(column, F.lit(seed))
    if total > 4 * n:
        rows = rows.where(F.shiftrightunsigned(h, 1) < F.lit(int(2**63 * (2 * n / total))))
    return rows.orderBy(h, column).limit(n)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df has not."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 texts; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and so many bytes of texts and binaries unless one row has more."""
    total = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            total += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(total), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, to - at)
        at = to


def free_memory() -> None:
    """Gives memory that this process doesn't use back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: By name, what frees the things that an operator keeps in a worker from task to task.
RELEASE: dict[str, Callable[[], None]] = {}


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives free memory back to the system; Spark keeps workers from task to task.

    Before, the worker drops what operators other than `keeps` have kept in it.
    """

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()

        def freed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                pool.release_unused()

        for name, release in RELEASE.items():
            if name != keeps:
                release()
        try:
            yield from run(freed())
        finally:
            free_memory()

    return all_


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema) -> DataFrame:
    """f over slices of batches, so that memory follows the slice and not the session's batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = f(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(tidied(run), schema)


def filter_arrow(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """Rows of df that keep() marks, with all their columns."""
    return map_arrow(df, lambda b: b.filter(pa.array(keep(b), pa.bool_())), df.schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before; emptied when it grows past its bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], width: int, cache: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of all width-word windows, sorted; a shorter sequence is one shingle; no words: none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    w = min(width, len(h))
    out = np.full(len(h) - w + 1, w, np.uint64)
    for i in range(w):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + h[i : len(h) - w + 1 + i])
    return np.unique(out)

