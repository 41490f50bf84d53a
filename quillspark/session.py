"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own; a cluster's own settings always win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def make_session(master: str = "local[8]", app: str = "quillspark", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass the cluster's own session instead."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes that Spark sends to Python at a time: a row may hold a whole text.
ARROW_ROWS, ARROW_BYTES = 1024, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches, so that a worker's memory doesn't follow a table's size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; only Spark's reader touches the path."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or a temp folder where that is unset (local masters)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillspark/{uuid.uuid4().hex}"


def stamp(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """What changes when a table's files do: their names, sizes and times."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))
