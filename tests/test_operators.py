"""Golden rows and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.model import parse_answer, parse_response
from quillspark.operators import hybrid, ingest, lexical, quality, split, tables, vector, workflow
from quillspark.session import scratch
from quillspark.sources import readers


def test_split_covers_the_text():
    text = ("Some words here, and more; then. " * 200).strip()
    got = split.windows(text, 512, 50)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b > a for a, b in got)
    assert all(c <= b for (_, b), (c, _) in zip(got, got[1:]))


def test_split_compat_goes_on_to_the_last_character():
    got = split.windows("x" * 612, 512, 50, compat=True)
    assert len(got) == 52
    assert got[-1] == (611, 612)
    assert len(split.windows("x" * 612, 512, 50)) == 2


def test_chunks_follow_sections(spark):
    rows = [(1, 0, "text", "RISK FACTORS", None, None, None, 1), (1, 1, "text", "Body one.", None, None, None, 1), (1, 2, "text", "BUSINESS", None, None, None, 2), (1, 3, "text", "word " * 200, None, None, None, 3)]
    e = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, text_level int, table_caption array<string>, table_body string, page_idx int")
    got = ingest.chunks(e, ingest.Config(300, 50)).orderBy("chunk_no").collect()
    assert got[0]["content"] == "# RISK FACTORS\n\nBody one." and got[0]["section_hierarchy"] == "RISK FACTORS"
    assert [r["chunk_no"] for r in got] == list(range(len(got))) and len(got) > 3
    assert all(r["section_hierarchy"] == "BUSINESS" for r in got[1:]) and got[1]["id"] == "doc-chunk-0001"


def test_chunks_of_no_elements(spark):
    e = spark.createDataFrame([], "doc_id long, pos int, type string, text string, text_level int, table_caption array<string>, table_body string, page_idx int")
    assert ingest.chunks(e).count() == 0


def test_lenient_reader_refuses_an_empty_file(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\nbroken\n")
    with pytest.raises(ValueError):
        readers.jsonl_lenient(spark, str(tmp_path / "x.jsonl"))


def test_strict_reader_fails_on_a_broken_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"a","content":"b"}\nbroken\n')
    with pytest.raises(Exception):
        readers.jsonl_strict(spark, str(tmp_path / "x.jsonl")).collect()


def test_tables_and_chunks_round_trip(spark, tmp_path):
    (tmp_path / "table_001_a.csv").write_text('x,"1,5"\n\n y ,2\n')
    got = readers.csv_tables(spark, str(tmp_path / "*.csv")).orderBy("pos").collect()
    assert [(r["filename"], r["pos"], r["cells"]) for r in got] == [("table_001_a.csv", 0, ["x", "1,5"]), ("table_001_a.csv", 1, ["y", "2"])]
    chunks = spark.createDataFrame([(0, "a", "text", ["S"], "S", 1, 4)], "chunk_no long, id string, content string, section_path array<string>, section_hierarchy string, page_idx int, chunk_size int")
    readers.write_chunks(chunks, str(tmp_path / "out"))
    assert readers.jsonl_strict(spark, str(tmp_path / "out")).select("id", "metadata.section_hierarchy").collect()[0][1] == "S"
    readers.write_envelope(chunks, spark.range(3), "s", "2025-01-01", str(tmp_path / "env"))
    assert spark.read.json(str(tmp_path / "env")).select("statistics.total_chunks", "statistics.total_tables").collect()[0] == (1, 3)
    assert readers.probe(spark, str(tmp_path / "table_001_a.csv")).collect()[0]["lines"] == 2


def test_wide_tables_keep_all_values(spark):
    name = "table_001_" + "_".join(f"w{i}" for i in range(1_100)) + ".csv"
    rows = [(name, 0, ["", *(["2024"] * 2)]), (name, 1, ["Revenue", *map(str, range(10_050))])]
    t = spark.createDataFrame(rows, "filename string, pos int, cells array<string>")
    got = tables.read_table(t, 2025, number=1, row_text="revenue").select("description", F.size("values").alias("n"), F.element_at("values", -1).alias("last")).collect()
    assert [(r["n"], r["last"], r["description"].split()[-1]) for r in got] == [(10_050, "10049", "w1099")]


def test_vector_table_upserts(spark):
    v = lambda rows: spark.createDataFrame(rows, "id string, x int")
    readers.write_vectors(v([("a", 1), ("b", 2)]), "vectors_test", replace=True)
    readers.write_vectors(v([("b", 3), ("c", 4)]), "vectors_test")
    readers.write_vectors(v([("d", 5)]), "vectors_test")
    assert sorted(map(tuple, spark.table("vectors_test").collect())) == [("a", 1), ("b", 3), ("c", 4), ("d", 5)]
    readers.write_vectors(v([("z", 0)]), "vectors_test", replace=True)
    assert spark.table("vectors_test").collect() == [("z", 0)]
    assert sum(t.name.startswith("vectors_test") for t in spark.catalog.listTables()) == 2


def test_bm25_is_indifferent_to_order_and_negative_for_common_terms(spark):
    rows = [(i, "common rare" if i == 0 else "common word") for i in range(6)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    two = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    s = lambda d: sorted(map(tuple, lexical.Index.build(d, scratch(spark)).all_scores(["common", "rare"]).select("id", F.round("score", 6)).collect()))
    assert s(one) == s(two)
    assert s(one)[1][1] < s(one)[0][1] and s(one)[1][1] < 0


def test_multiquery_keeps_the_best_of_variants(spark):
    chunks = spark.createDataFrame([(0, "alpha beta", "s", [1.0, 0.0]), (1, "gamma", "s", [0.0, 1.0])], "id long, content string, section string, embedding array<float>")
    index = lexical.Index.build(chunks, scratch(spark), "id", "content")
    both = {r["id"]: r["score"] for r in hybrid.multiquery(chunks, index, [("alpha", [1.0, 0.0]), ("gamma", [0.0, 1.0])]).collect()}
    one = {r["id"]: r["score"] for r in hybrid.multiquery(chunks, index, [("alpha", [1.0, 0.0])]).collect()}
    assert all(both[i] >= one[i] for i in one)
    assert hybrid.enhanced(chunks, index, [("alpha", [1.0, 0.0])]).collect()[0]["search_method"] == "hybrid"


def test_search_falls_back_when_it_runs(spark, monkeypatch):
    chunks = spark.createDataFrame([(0, "alpha beta " * 20, "s", [1.0, 0.0]), (1, "gamma", "s", [0.0, 1.0]), (2, "no vector", "s", None)], "id long, content string, section string, embedding array<float>")
    index = lexical.Index.build(chunks, scratch(spark), "id", "content")
    for at in index.segments:
        blocks = index._blocks(at)
        index._tables[f"{index.path}/segments/{at['segment']}/blocks"] = blocks.withColumn("packed", F.udf(lambda x: 1 / 0, "binary")("packed"))
    got = hybrid.enhanced(chunks, index, [("alpha", [1.0, 0.0])]).collect()
    assert [(r["id"], r["search_method"], r["fallback_reason"]) for r in got] == [(0, "vector_fallback", "hybrid_search_unavailable")]
    monkeypatch.setattr(hybrid, "rerank", None)
    got = hybrid.enhanced(chunks, None, [("alpha", [1.0, 0.0])]).collect()
    assert [r["id"] for r in got] == [0, 1] and {r["search_method"] for r in got} == {"basic_vector_fallback"}


def test_a_query_of_the_index_reads_no_text(spark):
    from quillspark.plans.queries import QUERIES, index_of

    index = index_of(spark, "/root/testdata/sf0.001")
    plan = QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "documents.parquet" not in plan
    scans = [x.split("\n")[0] for x in plan.split("FileScan parquet")[1:]]
    assert any("packed" in x for x in scans) and all("In(term, " in x for x in scans if "packed" in x)
    assert index.n_docs == 200 and index.terms.count() == index.postings.select("term").distinct().count()


def test_names_of_people_are_a_parameter():
    from quillspark.functions import vocab

    assert vocab.with_names(["jane"])[2][0][:2] == ["jane", "ceo"] and vocab.with_names([]) == vocab.RERANK


def test_blank_lines_do_not_overlap():
    text = "a" * 400 + "\n\n\n" + "b" * 400
    assert split.windows(text, 512, 50)[0] == (0, 402)


def test_tables_keep_the_whole_path_and_chunks_the_line_ends(spark):
    rows = [(1, 0, "text", "BUSINESS", 1, None, None, None), (1, 1, "text", "Deep part", 2, None, None, None), (1, 2, "table", None, None, None, "<tr><td>a</td></tr>", None)]
    e = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, text_level int, table_caption array<string>, table_body string, page_idx int")
    got = ingest.chunks(e).collect()
    assert got[1]["content"].startswith("# Deep part\n\n\n[TABLE 1] Data table from BUSINESS > Deep part section\nSection: BUSINESS > Deep part\n") and got[1]["content"].endswith(".csv\n")
    assert {r["page_idx"] for r in got} == {0}


def test_responses_are_parsed_and_merged(spark):
    schema = "answer string, confidence string, citations array<struct<section: string, page: int>>"
    assert parse_response({"object": {"answer": "x", "confidence": None}}, schema) == ({"answer": "x"}, [])
    assert parse_response({"text": 'so ```json\n{"answer": 5, "citations": [{"page": "x"}]}\n``` it is'}, schema) == ({"answer": 5, "citations": [{"page": "x"}]}, ["answer", "citations[0].page"])
    assert parse_response({"answer": "TBD", "n": [1]})[0] == {"n": [1]} and parse_response("nothing") == (None, [])
    assert parse_response('{"a": 1}', ["a", "b"]) == ({"a": 1}, ["b"])
    for bad, kind in (("nothing", None), ('{"answer": 5}', schema)):
        with pytest.raises(ValueError):
            parse_response(bad, kind, strict=True)
    assert quality.merged([{"a": [1, 2], "b": {"x": 1, "y": [1]}}, {"a": [2, 3, 3], "b": {"y": [2]}, "c": "TBD"}]) == {"a": [1, 2, 3], "b": {"x": 1, "y": [1, 2]}}


def test_tables_are_written_under_their_names(spark, tmp_path):
    from quillspark.plans.queries import ELEMENTS

    made = ingest.tables(ELEMENTS.literal.df(spark))
    got = {r["filename"]: r["bytes"] for r in readers.write_table_files(made, str(tmp_path / "csv")).collect()}
    assert len(got) == made.count() and all((tmp_path / "csv" / n).stat().st_size == b for n, b in got.items())
    back = readers.csv_tables(spark, str(tmp_path / "csv" / "*.csv"))
    assert back.where("pos = 0").count() == len(got)


def test_default_vocabulary_reranks(spark):
    rows = [(0, "Revenue and net income for the year, with a long enough text to pass the short text penalty of this ranking, really.", "Financial", 0.6), (1, "nothing of note in a text that is also long enough to pass the penalty for short ones, which is one hundred.", "Legal", 0.9), (2, "dropped", "x", 0.4)]
    d = spark.createDataFrame(rows, "id long, content string, section string, score double")
    got = hybrid.rerank(d, "revenue growth").collect()
    assert [r["id"] for r in got] == [0, 1] and got[0]["score"] > 1.2
    boosted = hybrid.boost(d.withColumn("content", F.lit("of $5 million")), "total revenue").orderBy("id").collect()
    assert boosted[0]["score"] == pytest.approx(0.6 * 1.5 * 1.3)


def test_dedupe_is_idempotent(spark):
    d = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "pos int, text string, v int")
    one = workflow.dedupe(d, ["text"])
    assert sorted(map(tuple, one.select("pos", "text", "v").collect())) == [(0, "a", 3), (1, "b", 2)]
    assert sorted(map(tuple, workflow.dedupe(one, ["text"]).select("pos", "text", "v").collect())) == [(0, "a", 3), (1, "b", 2)]


def test_inverted_file_with_all_lists_is_exact(spark):
    rows = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    f = vector.InvertedFile(rows, 8)
    q = [1.0, 2.0, 0.5]
    assert f.knn(q, 10, 8).collect() == vector.knn(rows, q, 10).collect()


def test_inverted_file_finds_what_brute_force_finds(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").cache()
    f = vector.InvertedFile(rows, 16)
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in rows.collect()}
    x = np.array(list(vectors.values()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = list(vectors), []
    for q in sorted(vectors)[::25]:
        score = (x @ x[ids.index(q)]).round(6)
        want = sorted(zip(-score, ids))[:10]
        got = [r["id"] for r in f.knn(vectors[q], 10, 8).collect()]
        hits.append(len({i for _, i in want} & set(got)) / 10)
    assert len(hits) >= 20 and np.mean(hits) > 0.99


def test_inverted_file_is_found_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    path = str(tmp_path / "lists")
    one, two = vector.InvertedFile(rows, 8, path=path), vector.InvertedFile.open(spark, path)
    q = [1.0, 2.0, 0.5]
    assert one.knn(q, 10, 2).collect() == two.knn(q, 10, 2).collect() == vector.knn(rows, q, 10).collect()
    assert vector.InvertedFile(rows.limit(0), 8, path=str(tmp_path / "none")).knn(q, 10, 8).count() == 0


def test_inverted_file_leaves_out_lists_of_grouped_vectors(spark):
    r = np.random.default_rng(0)
    middle = r.standard_normal((8, 16))
    v = middle[np.arange(400) % 8] + 0.02 * r.standard_normal((400, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(400, None)], "vec_id long, embedding array<float>").cache()
    f = vector.InvertedFile(rows, 8)
    for q in range(3):
        query = v[q].tolist()
        assert f.knn(query, 10, 1).collect() == vector.knn(rows, query, 10).collect()
        assert len(f.lists_of(query, 10, 1)) < len(f.widest)
    assert len(f.knn(v[0].tolist(), 500, 1).collect()) == 401
    assert vector.InvertedFile(rows.limit(0), 8).knn([1.0] * 16, 10, 8).count() == 0


def test_answers_fit_their_schema(spark):
    d = spark.createDataFrame([('text {"answer": "x", "confidence": "high"} more',)], "t string")
    r = d.select(parse_answer(F.col("t"), "base").alias("a")).select("a.answer", F.col("a.confidence").isin("high", "low"), F.size(F.coalesce("a.citations", F.array())) <= 5).collect()[0]
    assert tuple(r) == ("x", True, True)


def test_placeholders_go(spark):
    d = spark.createDataFrame([('{"a": "TBD", "b": "fine"}',)], "j string")
    assert d.select(quality.remove_placeholders("j")).collect()[0][0] == '{"b":"fine"}'


def test_generator_and_embedder_are_deterministic(spark):
    assert workflow.TemplateGenerator(spark).generate("ownership?") == workflow.TemplateGenerator(spark).generate("ownership?")
    e = vector.HashEmbedder(16)
    assert e.embed(["a b"]) == e.embed(["a b"]) and e.embed([""]) == [[0.0] * 16]


def test_trim_takes_every_white_space(spark):
    d = spark.createDataFrame([(" \t x ﻿\n",)], "t string")
    assert d.select(X.trim(F.col("t"))).collect()[0][0] == "x"


def test_entry_runs_without_the_other_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sections_hold_allowed_values_only():
    good = {"investment_recommendation": "Buy", "top_risks": [{"impact": "High"}] * 3, "confidence_level": "Low"}
    assert parse_response({"object": good}, section="executive_summary") == (good, [])
    bad = {"investment_recommendation": "Maybe", "top_risks": [{"impact": "High"}, {"impact": "huge"}, {"impact": "Low"}, {"impact": "Low"}], "catalysts": "none", "key_investment_highlights": [1]}
    assert parse_response({"object": bad}, section="executive_summary")[1] == ["investment_recommendation", "top_risks[1].impact", "top_risks"]
    risks = {"risk_categories": {"market_risks": [{"probability": "Low", "impact": "none"}]}, "risk_matrix": {"overall_risk_profile": "Bold"}}
    assert parse_response({"object": risks}, section="risk_assessment")[1] == ["risk_categories.market_risks[0].impact", "risk_matrix.overall_risk_profile"]
    with pytest.raises(ValueError, match="confidence_level"):
        parse_response({"object": {"confidence_level": "sure"}}, strict=True, section="valuation")


def test_section_paths_fold_headings(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for doc in range(12):
        path: list[str] = []
        for pos in range(60):
            what = r.choice(["major", "level", "words", "body"], p=[0.08, 0.4, 0.12, 0.4])
            level = int(r.integers(1, 7)) if what == "level" else None
            text = {"major": "Risk Factors", "words": f"Revenue {pos}", "level": f" part {doc}.{pos} ", "body": "plain words"}[what]
            rows.append((doc, pos, "text", text, level))
            if what == "major":
                path = ["Risk Factors"]
            elif what != "body":
                path = path[: (level or 2) - 1] + [text.strip()]
            want[doc, pos] = list(path)
    found = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, text_level int").repartition(5)
    got = ingest.section_paths(found).collect()
    kinds = {(x["doc_id"], x["pos"]): x["kind"] for x in got}
    assert {"MAJOR_HEADING", "HEADING", "TEXT"} == set(kinds.values())
    assert {(x["doc_id"], x["pos"]): x["path"] for x in got} == want


def test_section_paths_of_many_headings_are_linear(spark):
    n = 20_000
    found = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.lit("text").alias("type"), F.format_string("part %d", "id").alias("text"), F.lit(3).alias("text_level"))
    got = ingest.section_paths(found).where(F.col("pos") == n - 1).collect()
    assert got[0]["path"] == ["part 0", "part 1", f"part {n - 1}"]
