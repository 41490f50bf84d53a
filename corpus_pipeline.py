"""The corpus pipeline: quality classifier, quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result below spark.checkpoint.dir and reads it again as the next one's documents.

Defined results, in all stages: other columns of documents pass through; an empty table gives an empty result; repeated
rows are judged each, and of repeated or equal documents the near-duplicate stage keeps one row: that of smallest id, or
where no row of a group has an id any one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import cotraining, packing, parity_join, pii_crf, rule_forest
from quillspark.llm.common import scratch, stored, table

#: Words of a shingle and the least similarity of near duplicates.
WIDTH, NUM, DEN = 5, 80, 100
#: No stage is plain SQL.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the co-trained views score as good."""
    return cotraining.keep(docs, cotraining.train(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and isn't an anomaly among the documents left."""
    return rule_forest.keep(docs, rule_forest.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component, once."""
    return parity_join.keep_one(docs, WIDTH, NUM, DEN)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters anew."""
    return pii_crf.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
        return stored(STAGES[-1][1](spark, docs, sf_dir), lasting=True)
