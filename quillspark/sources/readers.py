"""Sources and sinks. Paths are anything Spark's readers open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import csv_cells, to_csv

ELEMENT = "type string, text string, text_level int, img_path string, table_caption array<string>, table_footnote array<string>, table_body string, page_idx int"
CHUNK = "id string, content string, metadata struct<section_path: array<string>, section_hierarchy: string, page_idx: int, chunk_type: string, chunk_size: int, timestamp: string>"


def elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements of JSON arrays: file, pos, and the fields. A file is a document's array; lines: a line is, so that a file holds many documents."""
    whole = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"array<struct<{ELEMENT.replace(' array<', ': array<').replace(' string', ': string').replace(' int', ': int')}>>").alias("e"))
    return whole.select("file", F.posexplode("e").alias("pos", "e")).select("file", "pos", "e.*")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", CHUNK, {"mode": "PERMISSIVE"}).alias("c")).select("c.*").withColumn("good", F.coalesce(F.expr("id <> '' AND content <> ''"), F.lit(False)))


def jsonl_lenient(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON lines file; blank and broken lines and those without id or content are left out. Raises if none is left."""
    good = _parsed(spark, path).where("good").drop("good")
    if not good.limit(1).count():
        raise ValueError(f"no valid chunk in {path}")
    return good


def jsonl_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines that jsonl_lenient() takes, and those, but for blank ones, that it leaves out."""
    return _parsed(spark, path).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))


def jsonl_strict(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON lines file; a broken line fails the read."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """(filename, pos, cells) of CSV files: blank lines dropped, lines numbered in file order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "").alias("lines"))
    return whole.select("filename", F.posexplode("lines").alias("pos", "line")).select("filename", "pos", csv_cells(F.col("line")).alias("cells"))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes and non-blank lines of the files of a path."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length").alias("bytes"))
    return size.join(spark.read.text(path).where(F.trim("value") != "").agg(F.count("*").alias("lines")))


def write_chunks(chunks: DataFrame, path: str, timestamp: str | None = None) -> None:
    """JSON lines, one chunk a line, with nested metadata; timestamp: when they were made, now if it isn't given."""
    made = F.lit(timestamp) if timestamp else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.struct("id", F.col("content").alias("text"), "section_path", "section_hierarchy", "page_idx", F.lit("text").alias("chunk_type"), "chunk_size", made.alias("timestamp"))
    chunks.select("id", "content", meta.alias("metadata")).write.mode("overwrite").json(path)


def write_envelope(chunks: DataFrame, tables: DataFrame, source: str, processed: str, path: str) -> None:
    """One JSON document with statistics and all chunks; for small corpora."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "id", "content", "section_hierarchy", "page_idx"))), lambda c: F.struct(c["id"].alias("id"), c["content"].alias("content"), c["section_hierarchy"].alias("section"), c["page_idx"].alias("page")))
    one = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct(F.try_element_at("section_path", F.lit(1))).alias("sections"), listed.alias("chunks")).join(tables.agg(F.count("*").alias("total_tables")))
    one.select(F.lit(source).alias("source"), F.lit(processed).alias("processing_date"), F.struct("total_chunks", "total_tables", "sections").alias("statistics"), "chunks").coalesce(1).write.mode("overwrite").json(path)


def write_vectors(vectors: DataFrame, name: str, replace: bool = False) -> None:
    """A vector index: `name` is a view of the newest version of its table.

    Rows of new ids only are appended. Otherwise a new version is written once, in which rows of known ids are replaced,
    and the view goes over to it, so readers see either the old rows or the new ones; then the old version is dropped.
    """
    spark = vectors.sparkSession
    known = spark.catalog.tableExists(name)
    old = spark.table(name) if known else None
    if known and not replace:
        vectors = vectors.select(old.columns)
        if not old.join(vectors.select("id"), "id", "left_semi").limit(1).count():
            vectors.write.insertInto(_version(spark, name))
            return
        vectors = old.join(vectors.select("id"), "id", "left_anti").unionByName(vectors)
    before = _version(spark, name) if known else None
    version = f"{name}_{uuid.uuid4().hex[:12]}"
    vectors.write.saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('version' = '{version}') AS SELECT * FROM {version}")
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {before}")


def _version(spark: SparkSession, name: str) -> str:
    """The table behind a vector index."""
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}["version"]


def write_table_files(tables: DataFrame, path: str) -> DataFrame:
    """Writes each table of tables(filename, data) as CSV under its own name below path, in tasks; (filename, bytes) of the files.

    path is anything that Arrow's file systems open; without a scheme it is one of Spark's default file system. A task
    that runs again writes the same bytes.
    """
    spark = tables.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path = str(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString())
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    rows = tables.select("filename", to_csv(F.col("data")).alias("csv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            names, sizes = b.column("filename").to_pylist(), []
            for name, text in zip(names, b.column("csv").to_pylist(), strict=True):
                data = (text or "").encode()
                with store.open_output_stream(f"{folder}/{name.replace('/', '_')}") as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["filename", "bytes"])

    return rows.mapInArrow(run, "filename string, bytes long")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)
