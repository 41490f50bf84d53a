"""The segmented index: pruned search against full scores, growth against a fresh build, packing against plain postings."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexical, postings
from quillspark.session import scratch


def corpus(n, seed=0, words=60):
    """Texts over a vocabulary of falling frequency, of lengths 0 to 200."""
    r = random.Random(seed)
    names, weights = [f"w{i:02d}" for i in range(words)], [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(r.choices(names, weights, k=r.choice([0, 3, 20, 60, 200])))) for i in range(n)]


def rounded(df):
    return sorted((r["id"], round(r["score"], 6)) for r in df.collect())


def by_hand(rows, terms):
    """BM25 over plain counts."""
    counts = {i: Counter(t.split()) for i, t in rows}
    n, mean = len(rows), sum(len(t.split()) for _, t in rows) / len(rows)
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for i, c in counts.items():
        dl = sum(c.values())
        out[i] = sum(np.log((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in terms if c[t])
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus(3000)


@pytest.fixture(scope="module")
def index(spark, rows):
    return lexical.Index.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch(spark))


def test_bits_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 300, 4096):
        no = np.sort(r.choice(4096, n, replace=False))
        tf = r.geometric(0.3, n) ** r.integers(1, 4)
        got = list(postings.blocks_of(no, np.zeros(n, np.int64), tf, np.full(4096, 50.0), 40.0))
        nos, tfs = zip(*(postings.unpacked(b[-1], b[1], b[3]) for b in got), strict=True)
        assert np.concatenate(nos).tolist() == no.tolist() and np.concatenate(tfs).tolist() == tf.tolist()
        f = postings.weight(tf, np.full(n, 50.0), 40.0)
        for (_, begin, span, m, low, high, tops, _), x in zip(got, np.split(np.arange(n), np.cumsum([b[3] for b in got])[:-1]), strict=True):
            assert ((no[x] >= begin) & (no[x] < begin + (1 << span))).all() and len(x) == m
            assert (f[x] <= high * postings.UNIT).all() and (low is None or (f[x] >= low * postings.UNIT).all())
            if tops:
                part = (no[x] - begin) * 8 >> span
                assert (f[x] <= np.frombuffer(tops, np.uint8)[part] / 255 * high * postings.UNIT + 1e-12).all()


@pytest.mark.parametrize("gathered", [True, False])
def test_pruned_search_equals_full_scores(spark, rows, index, monkeypatch, gathered):
    monkeypatch.setattr(lexical, "ONE_PASS", 0)
    if not gathered:
        monkeypatch.setattr(lexical, "SMALL", 0)
    for terms in (["w05", "w09"], ["w00", "w07"], ["w00", "w01"], ["w03", "w40", "w03"], ["w59"], ["nothing"], []):
        scores = by_hand(rows, terms)
        want = sorted(((-round(s, 6), i) for i, s in scores.items() if round(s, 6) > 0))[:10]
        got = [(-r["score"], r["id"]) for r in index.topk(terms, 10).collect()]
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1.1e-6)
        assert index.last_read is None or index.last_read[0] <= index.last_read[1]


def test_search_leaves_out_most_postings_of_frequent_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ONE_PASS", 0)
    big = lexical.Index.build(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), scratch(spark))
    whole = lambda terms: sorted(((-round(r["score"], 6), r["id"]) for r in big.scores({"q": terms}).collect() if round(r["score"], 6) > 0))[:10]
    for terms in (["and", "that"], ["the", "que"]):
        got = [(-r["score"], r["id"]) for r in big.topk(terms, 10).collect()]
        read, total = big.last_read
        assert got == whole(terms) and total > 8000 and read < total / 3
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(big.path.removeprefix("file://")) for f in fs if not f.startswith("."))
    postings_ = big.blocks.agg(F.sum("n")).collect()[0][0]
    assert size < 2.8 * postings_  # bytes


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path.removeprefix("file://")) for f in fs}


def test_grown_index_scores_as_a_fresh_one(spark, rows, monkeypatch):
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    some, rest = rows[:2700], rows[2700:]
    first = lexical.Index.build(make(some), scratch(spark))
    before = files(first.path)
    newer = [(i, f"w00 w00 changed {t}") for i, t in rows if i % 20 == 3]
    grown = first.append(make(rest)).replace(make(newer)).delete(make([(i, "") for i in range(100, 200)]))
    assert all(files(first.path)[k] == v for k, v in before.items())  # old segments are as they were
    now = {**dict(rows), **dict(newer)}
    now = [(i, t) for i, t in now.items() if not 100 <= i < 200]
    fresh = lexical.Index.build(make(now), scratch(spark))
    assert (grown.n_docs, round(grown.avg_dl, 9)) == (fresh.n_docs, round(fresh.avg_dl, 9))
    assert sorted(map(tuple, grown.terms.collect())) == sorted(map(tuple, fresh.terms.collect()))
    assert sorted(map(tuple, grown.postings.collect())) == sorted(map(tuple, fresh.postings.collect()))
    terms = ["w00", "w04", "changed"]
    assert rounded(grown.all_scores(terms)) == rounded(fresh.all_scores(terms))
    monkeypatch.setattr(lexical, "ONE_PASS", 0)
    assert [tuple(r) for r in grown.topk(terms).collect()] == [tuple(r) for r in fresh.topk(terms).collect()]
    assert first.n_docs == 2700 and rounded(first.all_scores(["w04"])) == rounded(lexical.Index(spark, first.path, 1).all_scores(["w04"]))
    # many small segments become one
    for i in range(4):
        grown = grown.append(make([(10_000 + i, f"w04 small {i}")]))
    merged = grown.merge()
    assert len(merged.segments) < len(grown.segments) and merged.n_docs == grown.n_docs
    assert rounded(merged.all_scores(terms)) == rounded(grown.all_scores(terms))
    again = merged.delete(make([(10_000, "")])).delete(make([(10_000, "")]))  # twice counts once
    assert again.n_docs == merged.n_docs - 1


def test_of_two_writers_the_later_fails(spark):
    make = lambda *x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string")
    one = lexical.Index.build(make("alpha beta", "gamma"), scratch(spark))
    with pytest.raises(Exception, match="(?i)exist"):
        spark.createDataFrame([(1,)], "a int").write.mode("error").parquet(f"{one.path}/versions/{1:010d}")
    assert lexical.Index.versions(spark, one.path) == [1] and one.append(make("delta")).version == 2


def test_index_of_odd_rows(spark):
    rows = [("a", None), ("b", ""), ("c", "the of"), ("d", "long " * 70_000), ("e", "long İstanbul $12% 日本語"), (None, "word"), ("e", "long")]
    index = lexical.Index.build(spark.createDataFrame(rows, "key string, body string"), scratch(spark), "key", "body")
    got = {(r["id"], r["term"]): r["tf"] for r in index.postings.collect()}
    assert got[("d", "long")] == 70_000 and got[("e", "$12%")] == 1 and got[(None, "word")] == 1
    lengths = sorted(((r["id"] or "", -1 if r["dl"] is None else r["dl"]) for r in index.lengths.collect()))
    assert lengths == [("", 1), ("a", -1), ("b", 0), ("c", 1), ("d", 70_000), ("e", 1), ("e", 3)]
    none = lexical.Index.build(spark.createDataFrame([], "doc_id long, text string"), scratch(spark))
    assert none.n_docs == 0 and none.topk(["word"]).count() == 0 and none.all_scores(["word"]).count() == 0
    assert none.topk_each({"a": ["word"]}, 3).count() == 0
    assert none.append(spark.createDataFrame([(1, "word one"), (2, "two two"), (3, "three")], "doc_id long, text string")).topk(["word"]).count() == 1
