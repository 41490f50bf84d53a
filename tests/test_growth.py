"""Search by tree and by table of queries, filtered lists, hot conversations, resumed embedding, long texts cut in parallel, many phrases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import ann, memory, split, vector
from quillspark.plans import queries
from quillspark.session import scratch
from quillspark.sources import readers

BIG = "/root/testdata/sf0.1"


def vectors(n, d=8, groups=0, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, (n, d)) + (r.normal(0, 6, (groups, d))[r.integers(0, groups, n)] if groups else 0)
    return [(i, [float(v) for v in row], i % 5) for i, row in enumerate(x.astype(np.float32))]


def nearest(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in queries:
        s = np.round(x @ (np.array(v) / np.linalg.norm(v)), 6)
        out[i] = [(int(ids[j]), round(float(s[j]), 6)) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.mark.parametrize("most", [ann.QUERIES, 40])
def test_table_of_queries_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(ann, "QUERIES", most)
    monkeypatch.setattr(ann, "BLOCK", 500)
    rows = vectors(1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    queries = [(i, v) for i, v, _ in rows if i % 15 == 0]
    got = {}
    found = ann.knn_all(df, spark.createDataFrame(queries, "query long, v array<float>"), 7)
    for r in sorted(found.collect()):
        got.setdefault(r["query"], []).append((r["id"], r["score"]))
    assert got == nearest(rows, queries, 7)


def test_plan_of_a_table_of_queries_does_not_grow(spark):
    df = spark.createDataFrame(vectors(50), "vec_id long, embedding array<float>, label int")
    sizes = [len(ann.knn_all(df, df.where(f"vec_id < {n}").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), 3)._jdf.queryExecution().optimizedPlan().toString()) for n in (2, 50)]
    assert abs(sizes[0] - sizes[1]) < 100 < sizes[0], sizes


def test_odd_vectors_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (None, [0.0, 1.0]), (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "query int, v array<double>")
    assert [tuple(r) for r in sorted(ann.knn_all(df, ask([3.0, 0.0], None, [0.0, 0.0], [1.0, 2.0, 3.0]), 2).collect())] == [(0, 1, 0, 1.0), (0, 2, 5, 1.0)]
    assert ann.knn_all(df.limit(0), ask([1.0, 0.0]), 2).count() == 0 and ann.knn_all(df, ask([1.0, 0.0]).limit(0), 2).count() == 0


def test_tree_finds_nine_of_ten_and_reads_a_tenth(spark):
    e = spark.read.parquet(f"{BIG}/embeddings.parquet")
    tree = ann.Tree.build(e, scratch(spark))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    truth, got = {}, {}
    for r in ann.knn_all(e, q, 10).collect():
        truth.setdefault(r["query"], set()).add(r["id"])
    for r in tree.search(q, 10, 40).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    assert len(truth) == 40 and np.mean([len(got[i] & truth[i]) / 10 for i in truth]) >= 0.9
    read = [r["count"] for r in tree.candidates(ann.units(q, "query", "v").withColumnRenamed("id", "query"), 40, 200).groupBy("query").count().collect()]
    assert len(read) == 40 and max(read) < tree.rows / 2
    lists = spark.read.parquet(f"{tree.path}/lists")
    assert lists.count() == 2 * tree.rows and lists.groupBy("row").count().where("count <> 2").count() == 0
    assert lists.select("row").distinct().count() == tree.rows == e.count()


def test_tree_of_equal_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 50)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rows = [(i, [1.0, 0.0, 0.0], 0) for i in range(400)] + [(1000 + i, [float(i), 1.0, 2.0], 0) for i in range(30)] + [(2000, None, 0), (2001, [0.0, 0.0, 0.0], 0), (2002, [1.0], 0)]
    tree = ann.Tree.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), scratch(spark))
    assert tree.rows == 430 and tree.d == 3
    ask = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(1, 9)], "query long, v array<float>")
    got = tree.search(ask, 1, 8, 50).collect()
    assert {r["query"]: r["id"] for r in got} == {i: 1000 + i for i in range(1, 9)}


def test_filtered_lists_equal_filtered_search(spark):
    rows = vectors(1200, groups=6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    lists = vector.InvertedFile(df, 12, path=scratch(spark), filters=("label",))
    read = []
    for label in range(5):
        for i in (0, 77, 500):
            want = [tuple(r) for r in vector.knn(df, rows[i][1], 10, where=F.col("label") == label).collect()]
            assert [tuple(r) for r in lists.knn_where(rows[i][1], 10, "label", [label]).collect()] == want
            read.append(len(lists.last_read))
    assert np.mean(read) < 12 / 2  # lists that hold the label but not near enough stay unread
    again = vector.InvertedFile.open(spark, lists.all.inputFiles()[0].split("/rows/")[0])
    assert [tuple(r) for r in again.knn_where(rows[0][1], 10, "label", [1, 3]).collect()] == [tuple(r) for r in vector.knn(df, rows[0][1], 10, where=F.col("label").isin(1, 3)).collect()]
    assert again.knn_where(rows[0][1], 10, "label", [99]).count() == 0
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    lists = vector.InvertedFile(e, 16, filters=("label",))
    q = [float(x) for x in e.where("vec_id = 3").collect()[0]["embedding"]]
    for r in e.select("label").distinct().collect():
        where = F.col("label") == r["label"]
        assert [tuple(x) for x in lists.knn_where(q, 10, "label", [r["label"]]).collect()] == [tuple(x) for x in vector.knn(e, q, 10, where=where).collect()]


def test_one_hot_conversation(spark):
    r = random.Random(2)
    rows = [(0, t, "user", f"text {t}", [r.gauss(0, 1), r.gauss(0, 1)] if t % 7 else None) for t in range(9000)] + [(c, t, "user", f"{c} {t}", [r.gauss(0, 1), 1.0]) for c in range(1, 101) for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, embedding array<double>").repartition(8)
    last = memory.last_messages(df.drop("embedding"), 5)
    assert sorted((x["conv_id"], x["turn"]) for x in last.collect()) == sorted([(0, t) for t in range(8995, 9000)] + [(c, t) for c in range(1, 101) for t in range(5, 10)])
    got = memory.semantic_recall(df, [1.0, 0.0], 3, 2)
    want = set()
    for c in range(101):
        mine = [x for x in rows if x[0] == c]
        hits = sorted((x for x in mine if x[4]), key=lambda x: (-round(x[4][0] / np.hypot(*x[4]), 6), x[1]))[:3]
        at = {x[1] for x in hits}
        want |= {(c, x[1], int(x[1] in at)) for x in mine if any(abs(x[1] - t) <= 2 for t in at)}
    assert {(x["conv_id"], x["turn"], x["hit"]) for x in got.collect()} == want and got.count() == len(want)
    # no task gets more than a tenth of the rows of what is dealt by slice of a conversation
    sizes = df.groupBy("conv_id", F.pmod(F.xxhash64("turn", "role", "text"), F.lit(memory.SLICES))).count().agg(F.max("count")).collect()[0][0]
    assert sizes < len(rows) / 10


def failing(path, bad=None):
    """An embedder that fails at a text and counts what it has embedded in a file; local, so that workers get it by value."""

    class Failing:
        dim = 2

        def embed(self, texts):
            if bad in texts:
                raise RuntimeError("no answer")
            with open(path, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

    return Failing()


def test_embedding_goes_on_where_it_failed(spark, tmp_path):
    path, log = f"file://{tmp_path}/store", str(tmp_path / "log")
    texts = [f"text number {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], None])], "doc_id long, text string")
    with pytest.raises(Exception, match="no answer"):
        vector.embed_into(df, failing(log, texts[150]), path, batch=10, round_rows=40)
    held = vector.stored_vectors(spark, path).count()
    assert 0 < held < 301
    open(log, "w").close()
    out = vector.embed_into(df, failing(log), path, batch=10, round_rows=40)
    assert len(open(log).read().split("\n")) - 1 == 301 - held  # the rest only, each text once
    got = {r["doc_id"]: list(r["embedding"]) for r in out.collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in enumerate([*texts, texts[0], None])}
    open(log, "w").close()
    assert vector.embed_into(df, failing(log), path).count() == 302 and not open(log).read()  # nothing is left


def test_rounds_of_embedding_read_their_own_texts_only(spark, tmp_path):
    """However many rounds there are, the documents are read twice: to deal and to join."""
    path, read = f"{tmp_path}/store", spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, f"text number {i % 400}") for i in range(600)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    out = vector.embed_into(df, failing(str(tmp_path / "log")), f"file://{path}", batch=5, round_rows=20)
    assert {r["doc_id"]: list(r["embedding"]) for r in out.collect()} == {i: [float(len(f"text number {i % 400}")), 1.0] for i in range(600)}
    assert read.value <= 2 * 600
    log = open(tmp_path / "log").read().split("\n")[:-1]
    assert len(log) == len(set(log)) == 400  # each text once
    assert os.listdir(path) == ["vectors"]  # the files of dealt texts are gone
    with pytest.raises(Exception, match="no answer"):
        vector.embed_into(df, failing(str(tmp_path / "log"), "text number 9"), f"file://{path}2", batch=5, round_rows=20)
    assert not [x for x in os.listdir(f"{path}2") if x != "vectors"]
    assert vector._rounds([("a", 3), ("b", 2), ("c", 6), ("d", 1), ("e", 4)], 5) == [["a", "b"], ["c"], ["d", "e"]] and vector._rounds([], 5) == []


def test_a_budget_of_calls_is_shared_out(spark, tmp_path):
    import time

    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    start = time.monotonic()
    vector.embed_into(df, failing(str(tmp_path / "log")), f"file://{tmp_path}/paced", batch=2, per_minute=240)
    # 20 calls or some more in uneven tasks, four a second, but for each task's first
    assert time.monotonic() - start > 3


def test_long_texts_are_cut_as_in_one_task(spark):
    r = random.Random(1)
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("text").limit(4200).collect()
    big = "\n".join(x["text"] for x in docs)
    assert len(big) > 10_000_000
    texts = [(1, big), (2, "x" * 300_000), (3, None), (4, ""), (5, "short one. two"), (6, " " * 50_000), (7, "".join(r.choice("ab \n.;,") for _ in range(60_000))), (None, "y" * 10_001 + " " + "z" * 40_000), (8, big[:6001])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    key = lambda x: tuple(-1 if v is None else v for v in x)
    want = sorted(map(key, split.split(df).collect()))
    for stretch in (1 << 18, 3000):
        assert sorted(map(key, split.split_long(df, stretch=stretch).collect())) == want
    small = spark.createDataFrame([(1, "ab " * 4000)], "doc_id long, text string")
    assert sorted(split.split_long(small, 100, 99, 500).collect()) == sorted(split.split(small, 100, 99).collect())
    assert split.split_long(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [100_000, 700])
def test_five_thousand_phrases_over_all_documents(spark, monkeypatch, size):
    from quillspark.operators import phrases

    monkeypatch.setattr(phrases, "DICTIONARY", size)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"].lower() for r in docs.collect()}
    r = random.Random(4)
    words = sorted({w for t in texts.values() for w in t.split()})
    some = [" ".join(t.split()[3:5]) for t in texts.values()]
    listed = list(dict.fromkeys([*some, *r.sample(words, 5000), "none of these words", "ä"]))[:5000]
    assert len(listed) == 5000
    df = spark.createDataFrame([*enumerate(listed), (9001, ""), (9002, None)], "phrase long, words string")
    got = sorted((x["id"], x["phrase"]) for x in phrases.found(docs, df).collect())
    sample = set(r.sample(range(5000), 300))
    assert [(i, p) for i, p in got if p in sample] == sorted((i, p) for i, t in texts.items() for p in sample if listed[p] in t)
    assert max(p for _, p in got) < 5000 and len(got) == len(set(got))


def test_odd_phrases(spark):
    from quillspark.operators import phrases

    docs = spark.createDataFrame([(1, "The Cat sat"), (2, None), (3, ""), (1, "a cat"), (None, "at")], "doc_id long, text string")
    df = spark.createDataFrame([(1, "the cat"), (2, ""), (3, None), (4, "AT"), (5, "at")], "phrase long, words string")
    assert sorted((str(r["id"]), r["phrase"]) for r in phrases.found(docs, df).collect()) == sorted([("1", 1), ("1", 4), ("1", 5), ("1", 4), ("1", 5), ("None", 4), ("None", 5)])
    assert phrases.found(docs, df.limit(0)).count() == 0 and phrases.found(docs.limit(0), df).count() == 0
    got = {(r["id"], r["list"]): (r["present"], r["all_"]) for r in phrases.listed(docs.where("doc_id = 1 AND text LIKE 'The%'"), {"a": ["cat", "sat", "dog"], "b": ["the"], "c": ["no"]}).collect()}
    assert got == {(1, "a"): (2, False), (1, "b"): (1, True)}


def test_hybrid_search_by_tree_finds_what_it_finds_by_all_vectors(spark):
    from quillspark.engine import Engine
    from quillspark.operators import hybrid
    from quillspark.plans.queries import ELEMENTS

    d = "/root/testdata/sf0.001"
    e = Engine.build(spark, ELEMENTS.df(spark, d), tree=True)
    assert e.tree is not None and e.tree.rows == e.chunks.count()
    variants = [(q, e.vector_of(q)) for q in ("risk of the business", "revenue growth")]
    plain = [(r["id"], r["score"]) for r in hybrid.multiquery(e.chunks, e.index, variants).orderBy("id").collect()]
    assert plain == [(r["id"], r["score"]) for r in hybrid.multiquery(e.chunks, e.index, variants, tree=e.tree, probes=64, keep=1000).orderBy("id").collect()]
    got = {r["id"] for r in e.enhanced_search("risk of the business").collect()}
    assert len(got & {r["id"] for r in hybrid.enhanced(e.chunks, e.index, e.variants("risk of the business")).collect()}) >= 9


def test_arrays_of_many_documents_share_files(spark, tmp_path, monkeypatch):
    """src_elements used to write a file for each document."""
    monkeypatch.setattr(queries, "scratch", lambda _: str(tmp_path / "arrays"))
    d = "/root/testdata/sf0.001"
    got = queries.src_elements(spark, d)
    rows = queries.ELEMENTS.df(spark, d)
    documents = rows.select("doc_id").distinct().count()
    assert len(list((tmp_path / "arrays").rglob("part-*"))) < documents / 4
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select(got.columns).collect()))


def test_lines_of_arrays_keep_every_character(spark, tmp_path):
    texts = ["a\nb\r\nc\rd", "  \x85", '"q" \\ \\n', "", None, "é 日 😀"]
    rows = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(texts)], "doc int, pos int, text string").repartition(1)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda e: F.struct(e["text"].alias("text")))
    rows.groupBy("doc").agg(F.to_json(listed).alias("value")).select("value").coalesce(1).write.text(str(tmp_path / "x"))
    found = readers.elements(spark, str(tmp_path / "x"), lines=True).select("pos", "text").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i // 2, x) for i, x in enumerate(texts)], key=str)
