"""Training on all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import rule_forest


@pytest.mark.parametrize("kind", ["both", "good", "bad"])
def test_op3_trains_on_all_labelled_rows(spark, kind):
    """More than 10,000 labelled documents, as on the driver: the forest's rows, span and threshold are those of all."""
    n = 10_600
    docs = spark.range(n, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array(*(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9 + i)).cast("string") for i in range(9))), F.when(F.col("id") % 41 == 0, "#### A A A A !!!")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id % 1000 = 0").withColumn("text", F.lit("# a second text")))
    good = {"both": F.col("doc_id") % 41 != 0, "good": F.lit(True), "bad": F.lit(False)}[kind]
    labels = docs.select("doc_id", good.cast("int").alias("quality")).distinct()
    texts = {}
    for r in docs.collect():
        texts[r["doc_id"]] = min(texts.get(r["doc_id"], r["text"]), r["text"])
    y = {r["doc_id"]: r["quality"] > 0 for r in labels.collect()}
    x = np.array([rule_forest.statistics(texts[i])[1] for i in range(n)])
    want, got = rule_forest.fit(x, np.array([y[i] for i in range(n)])), rule_forest.train(docs, labels)
    assert got.threshold == want.threshold and got.expected == want.expected
    for a in ("feature", "cut", "left", "path"):
        assert np.array_equal(getattr(got, a), getattr(want, a)), a
