"""The question workflow: fan-out, dedupe, citations, confidence."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import hypothetical
from .ann import knn_all
from .hybrid import reranked
from .vector import spare, top_per


class TextGenerator(Protocol):
    """Writes text for a prompt; a remote model fits behind it."""

    def generate(self, prompt: str) -> str: ...


class TemplateGenerator:
    """Offline: the template answer of a query."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def generate(self, prompt: str) -> str:
        return self.spark.range(1).select(hypothetical(F.lit(prompt))).collect()[0][0]


def fanout(chunks: DataFrame, terms: list[tuple[str, list[float]]], k: int = 10, keep: int = 5, lists: list[tuple[list[str], list[str], float]] = vocab.RERANK, least: float = 0.5) -> DataFrame:
    """(pos, term_no, id, content, section, score): reranked results of each term, in order of terms, then of scores.

    One pass over the vectors ranks all terms; texts join the winners.
    """
    asked = chunks.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, (_, v) in enumerate(terms)], "query int, v array<double>")
    best = knn_all(chunks, asked, k, "id").where(F.col("score") > least).select(F.col("query").alias("term_no"), "id", "score")
    found = F.broadcast(best).join(chunks.select("id", "content", "section"), "id")
    score = F.col("score")
    for i, (text, _) in enumerate(terms):
        score = F.when(F.col("term_no") == i, reranked(text, lists)).otherwise(score)
    kept = top_per(found.withColumn("score", score), ["term_no"], [F.desc("score"), F.col("id")], keep)
    # a few rows a term
    place = (F.row_number().over(Window.orderBy("term_no", F.desc("score"), "id")) - 1).cast("int")
    return kept.withColumn("pos", place).select("pos", "term_no", "id", "content", "section", "score")


def dedupe(rows: DataFrame, keys: list[str], pos: str = "pos", limit: int | None = None) -> DataFrame:
    """A row for each key: the place of its first row, the values of its last; the first `limit` places."""
    rest = [c for c in rows.columns if c not in (*keys, pos)]
    last = spare(rows, "last")
    one = rows.groupBy(*keys).agg(F.min(pos).alias(pos), F.max_by(F.struct(*rest), pos).alias(last))
    one = one.select(pos, *keys, *(F.col(last)[c].alias(c) for c in rest))
    return one.orderBy(pos).limit(limit) if limit else one


def context(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row: numbered texts with section and page; a page of 0 or none is N/A. For a handful of rows."""
    page = F.when(F.coalesce("page", F.lit(0)) == 0, "N/A").otherwise(F.col("page").cast("string"))
    item = F.struct(F.col(pos).alias("p"), F.concat(F.col("content"), F.lit("\n[Section: "), F.coalesce("section", F.lit("N/A")), F.lit(", Page: "), page, F.lit("]")).alias("t"))
    listed = F.sort_array(F.collect_list(item))
    return rows.agg(F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n\n").alias("context"))


def citations(texts: DataFrame, tables: DataFrame) -> DataFrame:
    """(pos, section, page, type) of text and table rows (pos, section, page): the first place of each, tables after all texts."""
    t = texts.select("pos", "section", "page", F.lit("text").alias("type"))
    after = F.broadcast(texts.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("after")))
    listed = tables.join(after).select((F.col("pos") + F.col("after")).cast("int").alias("pos"), "section", "page", F.lit("table").alias("type"))
    return t.unionByName(listed).groupBy("section", "page", "type").agg(F.min("pos").alias("pos"))


def confidence(results: DataFrame) -> DataFrame:
    """One row: high for more than three results of which the first scores over 0.8, medium for any, else low."""
    s = results.agg(F.count("*").alias("n"), F.min_by("score", "pos").alias("first"))
    return s.select("n", F.when((F.col("n") > 3) & (F.col("first") > 0.8), "high").when(F.col("n") > 0, "medium").otherwise("low").alias("confidence"))


def tier(valid: Column, points: Column, names: tuple[str, str, str] = ("High", "Medium", "Low")) -> Column:
    return F.when(valid, names[0]).when(points > 10, names[1]).otherwise(names[2])


def overall(level: Column) -> Column:
    """High or Medium if at least three levels say so, else Low; an aggregate."""
    return F.when(F.count_if(level == "High") >= 3, "High").when(F.count_if(level == "Medium") >= 3, "Medium").otherwise("Low")
