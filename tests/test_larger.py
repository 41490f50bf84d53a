"""Rows that only larger or odd tables hold, against the queries' SQL; and what operators must bound."""

import os
from itertools import count

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import lexical, phrases, postings, quality, split
from quillspark.operators.vector import _word_hash
from quillspark.plans import queries as plain

D = "/root/testdata/sf0.001"


def plainly(x):
    """Signs of zero count."""
    return "nan" if isinstance(x, float) and x != x else repr(x)


def as_sql(spark, tmp_path, name, **tables):
    """A query over some tables of rows (schema, rows), as (Spark's rows, SQL's rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for t in os.listdir(D):
        if t[:-8] not in tables:
            con.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{D}/{t}'")
    got, want = plain.QUERIES[name](spark, str(tmp_path)), con.sql(plain.ORACLES[name])
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    return sorted([plainly(r[c]) for c in cols] for r in got.collect()), sorted([plainly(r[i]) for i in at] for r in want.fetchall())


def odd_words():
    """Texts whose weighted sum rounds to 0 from below, and one whose words cancel each other."""
    place = lambda w: (_word_hash(w) % 64 + 1, _word_hash(w) >> 31)
    held = {}
    for n in count():
        held.setdefault(place(f"w{n}"), f"w{n}")
        if len(held) == 128:
            break
    plus, minus = ({i: held[i, s] for i in range(1, 65)} for s in (1, 0))
    # 3 i - 3i: only what single precision drops is left
    sums = [f"{3 * (x[i] + ' ')}{y[3 * i]}" for x, y in ((plus, minus), (minus, plus)) for i in range(1, 20)]
    return [*sums, f"{plus[5]} {minus[5]}"]


@pytest.mark.parametrize("name", ["embed_docs", "embed_store"])
def test_signs_of_zero_and_special_capitals(spark, tmp_path, name):
    texts = [*odd_words(), "ΟΔΟΣ ΑΣ", "İSTANBUL İ", "ς Σ", None, "", "?!"]
    got, want = as_sql(spark, tmp_path, name, documents=("doc_id long, text string", list(enumerate(texts))))
    assert got == want
    assert any("-0.0" in r for r in got) and any("nan" in r for r in got)


def test_the_first_list_of_answers_is_without_repeats_too(spark, tmp_path):
    rows = [(1, 1, 1000007, 7), (1, 2, 1000007, 8), (2, 1, 1000007, 7), (3, 1, 5, 17)]
    got, want = as_sql(spark, tmp_path, "merge_responses", lineitem=("l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long", rows))
    assert got == want and any("[1000007]" in x for r in got for x in r)
    assert quality.merged([{"a": [1, 1], "b": {"x": [2, 2]}}, {"a": [1, 3], "b": {"x": [2]}}]) == {"a": [1, 3], "b": {"x": [2]}}


def test_many_blocks_unpack_as_each_does():
    r = np.random.default_rng(3)
    no, term = np.nonzero(r.random((postings.WIDTH, 40)) < r.random(40) ** 4)
    no, term = np.append(no, r.integers(0, postings.WIDTH, 9)), np.append(term, np.arange(40, 49))
    tf = np.where((r.random(len(no)) < 0.5) | (term >= 40), 1, r.integers(1, 1 << r.integers(1, 20, len(no))))
    made = list(postings.blocks_of(no, term, tf, np.full(postings.WIDTH, 100), 80.0))
    packed, begin, n = [b[7] for b in made], np.array([b[1] for b in made]), np.array([b[3] for b in made])
    each = [postings.unpacked(*x) for x in zip(packed, begin, n)]
    got = postings.unpacked_all(pa.array(packed, pa.binary()), begin, n)
    assert all(np.array_equal(g, np.concatenate([e[i] for e in each])) for i, g in enumerate(got))
    assert sorted(zip(got[0], got[1])) == sorted(zip(no, tf)) and b"" in packed
    assert all(len(x) == 0 for x in postings.unpacked_all(pa.array([], pa.binary()), begin[:0], n[:0]))


@pytest.mark.parametrize("name", ["term_freq", "doc_freq", "term_idf"])
def test_terms_of_repeated_and_missing_ids(spark, tmp_path, name):
    rows = [(1, "one two two"), (1, "two three"), (None, "one one"), (None, "one four"), (2, None), (3, ""), (4, "Two Êone $five%"), (5, "two")]
    got, want = as_sql(spark, tmp_path, name, documents=("doc_id long, text string", rows))
    assert got == want


def test_parts_of_an_index_are_bounded_by_postings(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lexical, "PART_POSTINGS", 2000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("term"), (i * 7 + F.col("id") * 11) % 997)), " ").alias("text"))
    index = lexical.Index.build(docs, str(tmp_path / "i"))
    assert index.docs.select("stripe").distinct().count() >= 300 * 49 // 2000
    assert index.postings.count() == lexical.term_freq(docs).count()


def test_texts_are_counted_in_bounded_slices():
    b = pa.record_batch({"id": list(range(3000)), "text": ["x" * 10_000] * 2999 + ["y" * (9 << 20)]})
    got = [(p.num_rows, sum(map(len, p.column("text").to_pylist()))) for p in postings.slices(b)]
    assert sum(n for n, _ in got) == 3000 and all(n <= postings.ROWS_AT_ONCE and (size <= postings.SLICE or n == 1) for n, size in got)


def test_equal_phrases_are_looked_for_once(spark, tmp_path, monkeypatch):
    """Phrases that repeat under other numbers count each; the automaton gets each of them once."""
    asked, found = [], phrases.found
    monkeypatch.setattr(phrases, "found", lambda texts, known, **x: asked.append([r["words"] for r in known.collect()]) or found(texts, known, **x))
    parts = [(i, ("Red Tin", "green box", "")[i % 3]) for i in range(60)] + [(1_000_000, "cat")]
    pages = [(0, "-" * 199 + "a Gre")]  # of the same number as the cat
    got, want = as_sql(spark, tmp_path, "phrase_hits", documents=("doc_id long, text string", [(1, "a RED tin and a Green box, cat"), (2, "red tins"), (3, None), (4, "box")]), benchmark=("item_id long, text string", []), pages=("page_id long, html string", pages), part=("p_partkey long, p_name string", parts))
    assert got == want and len(got) == 2
    assert sorted(asked[0]) == ["a gre", "cat", "green box", "red tin"]


def test_texts_are_split_in_bounded_slices(spark, monkeypatch):
    asked, kept = [], split.slices
    df = spark.createDataFrame([(i, "word. " * 500) for i in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, split.split(df, 512, 50).collect()))
    monkeypatch.setattr(postings, "ROWS_AT_ONCE", 3)
    batch = pa.record_batch({"doc_id": list(range(40)), "text": ["word. " * 500] * 40})
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: asked.extend(b.num_rows for b in run(iter([batch]))) or self)
    split.split(df, 512, 50)
    assert kept is postings.slices and len(asked) == 14 and sum(asked) == len(want)
