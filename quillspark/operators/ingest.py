"""From page elements to section-aware chunks and tables.

elements(doc_id, pos, type, text, text_level, table_caption, table_body, page_idx), pos being the order in a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import has_any, trim
from .split import pieces
from .tables import describe, html_cells


@dataclass(frozen=True)
class Config:
    chunk_size: int = 1800
    chunk_overlap: int = 300
    id_prefix: str = "doc"
    compat: bool = False


def classify(type_: Column, text: Column, level: Column) -> Column:
    """MAJOR_HEADING, HEADING, TABLE or TEXT."""
    upper = F.upper(trim(text))
    words = "^(" + "|".join(vocab.HEADING_WORDS) + ")"
    return (
        F.when(type_ == "table", "TABLE")
        .when(F.coalesce(text, F.lit("")) == "", "TEXT")
        .when(upper.isin(vocab.MAJOR_SECTIONS) | has_any(upper, vocab.MAJOR_PHRASES), "MAJOR_HEADING")
        .when((level > 0) | upper.rlike(words), "HEADING")
        .otherwise("TEXT")
    )


def section_paths(elements: DataFrame) -> DataFrame:
    """elements with kind, section number in the document (from 0) and section path.

    A heading of level l keeps the first l - 1 names of the path before it and adds its own; a major one begins anew. So the
    i-th heading's depth is the lesser of l and one more than the depth before, which is i plus the least l - i so far; and
    the name at each depth up to its own is that of the last heading of that depth. Both are running windows, and rows are
    as many as the names of all headings' paths. The other elements take the path of the heading before them.
    """
    e = elements.withColumn("kind", classify(F.col("type"), F.col("text"), F.col("text_level")))
    heading = F.col("kind").isin("MAJOR_HEADING", "HEADING")
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("section", F.sum(heading.cast("int")).over(so_far))
    level = F.when(F.col("kind") == "MAJOR_HEADING", 1).when(F.coalesce("text_level", F.lit(0)) > 0, F.col("text_level")).otherwise(2)
    heads = e.where(heading).select("doc_id", "section", "pos", level.alias("level"), trim(F.col("text")).alias("name"))
    heads = heads.withColumn("depth", F.col("section") + F.least(F.lit(0), F.min(F.col("level") - F.col("section")).over(so_far)))
    names = heads.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    alike = Window.partitionBy("doc_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = names.withColumn("name", F.last(F.when(F.col("at") == F.col("depth"), F.col("name")), ignorenulls=True).over(alike))
    paths = names.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("path"))
    return e.join(paths, ["doc_id", "section"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))


def tables(elements: DataFrame) -> DataFrame:
    """(doc_id, pos, table_no, filename, section, n_rows, n_cols, data, reference) of the table elements with rows.

    Numbers count all table elements of a document, also those without rows.
    """
    t = section_paths(elements).where(F.col("kind") == "TABLE")
    t = t.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    last = F.try_element_at("path", F.lit(-1))
    t = t.withColumn("data", html_cells(F.col("table_body"))).where(F.size("data") > 0)
    slug = F.coalesce(F.array_join(F.slice(F.split(F.lower(last), " "), 1, 3), "_"), F.lit("unknown"))
    t = t.withColumn("filename", F.format_string("table_%03d_%s.csv", "table_no", slug)).withColumn("section_name", F.coalesce(last, F.lit("Unknown")))
    t = t.withColumn("n_rows", F.size("data")).withColumn("n_cols", F.size(F.col("data")[0]))
    whole = F.array_join("path", " > ")
    about = describe(F.col("filename"), whole, F.coalesce("table_caption", F.array().cast("array<string>")))
    t = t.withColumn("reference", F.format_string("\n[TABLE %d] %s\nSection: %s\nDimensions: %d rows × %d columns\nFile: %s\n", "table_no", about, whole, "n_rows", "n_cols", "filename"))
    return t.select("doc_id", "pos", "table_no", "filename", F.col("section_name").alias("section"), "n_rows", "n_cols", "data", "reference")


def chunks(elements: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, chunk_no, id, content, section_path, section_hierarchy, page_idx, chunk_size) in document order, numbers from 0.

    A section (heading to heading) is folded by one Arrow function over its parts; sections of one document run in
    parallel.
    """
    e = section_paths(elements)
    refs = tables(elements).select("doc_id", "pos", "reference")
    e = e.join(refs, ["doc_id", "pos"], "left")
    part = F.when(F.col("kind").isin("MAJOR_HEADING", "HEADING"), F.concat(F.lit("# "), trim(F.col("text")))).when(F.col("kind") == "TABLE", F.col("reference")).otherwise(trim(F.col("text")))
    e = e.withColumn("part", part)
    # a section is flushed by the next heading, with the page of the element before that, 0 if it has none
    rows = e.select("doc_id", "section", "pos", "kind", "part", "path", "page_idx").repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "pos")

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        """Chunks of one section."""
        doc, section, path = rows[0][0], rows[0][1], rows[0][5]
        parts, n = [], 0
        for _, _, _, kind, part, _, page in rows:
            if part:
                parts.append(part)
            text = "\n\n".join(parts)
            if kind == "TEXT" and part and len(text) > config.chunk_size:
                cut = [t for _, t in pieces(text, config.chunk_size, config.chunk_overlap, config.compat)]
                for t in cut[:-1]:
                    yield doc, section, n, t, path, page
                    n += 1
                parts = cut[-1:]
        if parts:
            yield doc, section, n, "\n\n".join(parts), path, rows[-1][6] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in [*batches, None]:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True) if b is not None else [None]:
                if held and (row is None or row[:2] != held[0][:2]):
                    out += fold(held)
                    held = []
                if row is not None:
                    held.append(row)
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "section", "n", "content", "section_path", "page_idx"])

    typed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("section").cast("long").alias("section"), "pos", "kind", "part", "path", F.col("page_idx").cast("int").alias("page_idx"))
    made = typed.mapInArrow(run, "doc_id long, section long, n int, content string, section_path array<string>, page_idx int")
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("section", "n")) - 1).cast("long")
    return made.withColumn("chunk_no", number).select("doc_id", "chunk_no", F.format_string(config.id_prefix + "-chunk-%04d", "chunk_no").alias("id"), "content", "section_path", F.array_join("section_path", " > ").alias("section_hierarchy"), "page_idx", F.length("content").alias("chunk_size"))


def corpus_stats(chunks_: DataFrame, tables_: DataFrame) -> DataFrame:
    """One row: chunks, tables, first sections, mean chunk size rounded half up."""
    first = F.nullif(F.try_element_at("section_path", F.lit(1)), F.lit(""))
    return chunks_.agg(F.count("*").alias("total_chunks"), F.countDistinct(first).alias("sections"), F.floor(F.avg("chunk_size") + 0.5).cast("long").alias("avg_chunk_size")).join(tables_.agg(F.count("*").alias("total_tables")))
