"""Token files and their index, Yinyang clustering, fill-in-the-middle: brute force, round trips, edge cases."""

import hashlib
import re
import threading
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, common, fill_middle, registry, token_files, yinyang

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, id long, key string, shard int, output string, n long, h string"


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd(spark):
    more = ("s", 7, "k", 3, "o", 9, "h")
    texts = [(0, None), (1, ""), (2, " \n\n\t"), (3, "one\ntwo"), (4, "a <M> in it\n"), (5, "x\n" * 30_000), (6, "word " * 60_000), (6, "again"), (6, "again"), (None, "no id"), (None, None), (-9, "日本語\n🙂 é́\n\n<|endoftext|>\n"), (2**63 - 1, "last\r\nline"), (-(2**63), "\nfirst")]
    return spark.createDataFrame([(*t, *more) for t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- token files
def by_hand(rows, tok):
    """(doc_id, start, n, crc) in ascending order of ids."""
    at, out = 0, []
    for r in rows:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_op11_by_hand(spark, tok):
    rows = spark.read.parquet(f"{D}/documents.parquet").orderBy("doc_id").collect()
    got = registry.QUERIES["op11_token_files"](spark, D).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, tok)


def test_files_are_raw_ids(spark, tok, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    token_files.write(docs, f"file://{tmp_path}/a")
    raw = b""
    for name in sorted((tmp_path / "a/ids").glob("part-*")):
        content = memoryview(name.read_bytes())
        kind, keys, counts = token_files.directory(content)
        assert kind == "<u2" and keys == sorted(keys)
        raw += bytes(content[: 2 * int(counts.sum())])
    want = [i for r in docs.orderBy("doc_id").collect() for i in [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]]
    assert np.frombuffer(raw, "<u2").tolist() == want


@pytest.mark.parametrize("docs_a_shard", [token_files.SHARD_DOCS, 2])
def test_token_files_of_odd_rows(spark, tok, odd, none, tmp_path, monkeypatch, docs_a_shard):
    monkeypatch.setattr(token_files, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(token_files, "BUCKET", 3)
    files = token_files.write_indexed(odd, f"file://{tmp_path}/odd")
    got = files.read(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), n, c) for i, _, n, c in by_hand(odd.collect(), tok))
    spans = sorted((r["start"], r["n_tokens"]) for r in got)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order[:2] == [None, None] and in_order[2:] == sorted(in_order[2:])
    assert files.read(none).count() == 0
    strange = spark.createDataFrame([(i,) for i in range(100, 400)], "doc_id long")
    assert files.lookup(strange).count() == 0  # fingerprints refuse unknown keys
    # some keys alone, with their ids
    few = files.read(odd.where("doc_id IN (3, 6)").select("doc_id")).collect()
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in few) == sorted([*tok.encode(t, add_special_tokens=False).ids, 1] for t in ("one\ntwo", "word " * 60_000, "again", "again"))


def test_token_files_without_documents(spark, none, tmp_path):
    files = token_files.write_indexed(none, f"file://{tmp_path}/none")
    assert files.read(none).count() == 0 and files.lookup(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_wide_ids(spark, tok, tmp_path):
    docs = spark.createDataFrame([(2, "b c"), (1, "a")], "doc_id long, text string")
    files = token_files.write_indexed(docs, f"file://{tmp_path}/wide", end=49_407)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in files.read(docs).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 49_407] for i, t in ((1, "a"), (2, "b c"))}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 5000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    slots = token_files.slots_of(keys, token_files.perfect(keys), n)
    assert sorted(slots.tolist()) == list(range(n))


# ---------------------------------------------------------------- clustering
def lloyd(ids, v, clusters, rounds, seed):
    """Full scans in Python's integers."""
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), v[i]))
    c = [list(v[i]) for i in order[:clusters]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(c))

    for _ in range(rounds):
        of = [nearest(x)[1] for x in v]
        for k in range(len(c)):
            mine = [x for x, o in zip(v, of, strict=True) if o == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((str(i), nearest(x)[1], nearest(x)[0]) for i, x in zip(ids, v, strict=True)), c


@pytest.mark.parametrize(("spread", "clusters"), [(1, 16), (3, 9), (40, 16), (40, 5)])
def test_yinyang_equals_full_scans(spark, spread, clusters):
    r = np.random.default_rng(spread)
    middles = r.integers(-100, 100, (6, 4))
    v = [[int(x) for x in middles[i % 6] + r.integers(-spread, spread + 1, 4)] for i in range(600)] + [[0, 0, 0, 0]] * 40
    rows = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got, c = yinyang.cluster(rows, clusters, 6, 5, dim=4, scale=1)
    want, cw = lloyd(list(range(len(v))), v, clusters, 6, 5)
    got = got.collect()
    assert sorted((str(x["id"]), x["cluster"], x["distance"]) for x in got) == want and c.tolist() == cw
    full = 7 * clusters * len(v)
    assert sum(x["scanned"] for x in got) < (0.8 if spread < 40 else 1) * full  # the filters leave distances out


def test_yinyang_with_coinciding_centroids_and_ties(spark):
    v = [[i % 3, (i // 3) % 3] for i in range(90)]
    rows = spark.createDataFrame([(i % 7, [float(x) for x in y]) for i, y in enumerate(v)], "vec_id long, embedding array<float>")
    got, c = yinyang.cluster(rows, 8, 4, 1, dim=2, scale=1)
    want, cw = lloyd([i % 7 for i in range(90)], v, 8, 4, 1)
    assert sorted((str(x["id"]), x["cluster"], x["distance"]) for x in got.collect()) == want and c.tolist() == cw


def test_yinyang_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, cluster int, v string"
    rows = [(1, [0.5, -0.26]), (1, [0.5, -0.26]), (None, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got, c = yinyang.cluster(df, 16, 3, 1, dim=2, scale=64)
    assert sorted((str(x["id"]), x["distance"]) for x in got.collect()) == [("1", 0), ("1", 0), ("None", 0)] and len(c) == 3
    assert [32, -17] in c.tolist()  # floor, not rounding
    got, c = yinyang.cluster(df.limit(0), 16, 3, 1, dim=2)
    assert got.count() == 0 and len(c) == 0
    with pytest.raises(Exception, match="too large"):
        yinyang.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dim=2)


# ---------------------------------------------------------------- fill in the middle
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"(?s)^[\t-\r\x20\x85\xa0\u2028\u2029\u3000]+|[^\t-\r\x20\x85\xa0\u2028\u2029\u3000]+[\t-\r\x20\x85\xa0\u2028\u2029\u3000]*", "char": r"(?s)."}


def test_runs_against_units():
    r = np.random.default_rng(3)
    texts = ["", "\n", "a", "\n\n\na", "a\n\n", "🙂\n é\n\n\n b", *("".join(r.choice(list("ab \n\t🙂é"), 30)) for _ in range(300))]
    for unit, pattern in UNITS.items():
        for t in texts:
            units = re.findall(pattern, t)
            runs = fill_middle.Runs.of(t, unit)
            assert runs.total == len(units) and "".join(units) == t
            assert [runs.offset(k) for k in range(len(units) + 1)] == np.cumsum([0, *map(len, units)]).tolist(), (unit, t)


def test_long_text_of_one_line_and_of_line_ends():
    for t in ("x" * 3_000_000, "\n" * 3_000_000):
        runs = fill_middle.Runs.of(t)
        assert len(runs.ends) == 1 and runs.total in (1, 3_000_000) and runs.offset(runs.total) == 3_000_000


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_forms_by_hand(spark, odd, unit):
    out = fill_middle.restore(fill_middle.transform(odd, unit, rate=80, spm=40, seed=11)).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)
    forms = set()
    for (i, t), r in zip(texts, sorted(out, key=lambda r: str((r["doc_id"], r["text"] or ""))), strict=True):
        digest = hashlib.sha256(f"11:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * j : 8 * j + 8], 16) for j in range(4)]
        units = re.findall(UNITS[unit], t)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 80
        want = t if plain else f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 40 else f"<P>{p}<S>{s}<M>{m}"
        assert r["output"] == want and r["restored"] == t and r["n"] == len(units)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if plain else (len(p), len(m)))
        assert r["source"] == "s" and r["h"] == "h"
        forms.add(r["form"])
    assert forms == {"plain", "psm", "spm"}


def test_fill_middle_without_rows(none):
    out = fill_middle.transform(none)
    assert out.count() == 0 and set(out.columns) == {*SCHEMA_NAMES, "form", "prefix_chars", "middle_chars"}


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


# ---------------------------------------------------------------- side by side
def test_all_queries_side_by_side_in_one_session(spark):
    """Each query in a thread of its own gives what it gives alone, and scratch tables of the others stay."""
    import corpus_pipeline

    jobs = {k: f for k, f in registry.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
    shape = lambda df: sorted(map(str, df.collect()))
    alone = {k: shape(f(spark, D)) for k, f in jobs.items()}
    together, failed = {}, {}

    def run(k, f):
        try:
            together[k] = shape(f(spark, D))
        except Exception as e:  # noqa: BLE001
            failed[k] = e

    threads = [threading.Thread(target=run, args=x) for x in jobs.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    # pieces of one document depend on the order in which parts are read; rows are compared without their places there
    same = [k for k in jobs if alone[k] == together[k]]
    assert set(jobs) - set(same) <= {"op6_packing", "pipeline"} and all(len(alone[k]) > 0 for k in jobs)
    assert common._OPEN.get() == ()


# ---------------------------------------------------------------- mended
def test_ids_up_to_the_largest_keep_their_components(spark):
    from quillspark.llm import parity_join

    t = "the small cat sat on a warm mat and then it went away to look for food in the quiet garden"
    rows = [(2**63 - 1, t), (2**62, t), (5, t + " x"), (-(2**63), "other words that are quite different from all the rest of them"), (None, "no id at all"), (2**62 + 1, "single text of its own here"), (None, t)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["id"]), str(r["component_id"])) for r in parity_join.near_duplicates(d, 4, 85, 100).collect())
    assert got == sorted([(str(2**63 - 1), "5"), (str(2**62), "5"), ("5", "5"), (str(-(2**63)), str(-(2**63))), ("None", "None"), (str(2**62 + 1), str(2**62 + 1)), ("None", "5")])
    kept = parity_join.keep_one(d, 4, 85, 100)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["5", str(-(2**63)), "None", str(2**62 + 1)])


def test_threshold_is_the_best_of_all_scores():
    from quillspark.llm import rule_forest

    r = np.random.default_rng(5)
    x = np.vstack([r.normal(0, 1, (9000, 4)), r.normal(2.5, 1.5, (3000, 4))])
    good = np.arange(12_000) < 9000
    forest = rule_forest.fit(x, good, 0.9)
    score = forest.score(x)
    cuts = np.unique(score)
    cuts = cuts[cuts >= np.quantile(score[good], 0.9)]
    assert len(cuts) > 4000 / 4
    worth = lambda c: (score[~good] > c).mean() - 4 * (score[good] > c).mean()
    assert forest.threshold in cuts and worth(forest.threshold) >= max(map(worth, cuts)) - 1e-12


def test_language_sample_counts_ids_not_rows(spark):
    from quillspark.llm import hypervectors

    words = {"en": "the cat and the dog", "de": "der hund und die katze"}
    rows = [(i, g, f"{words[g]} {i}") for i in range(4000) for g in words]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ten = d.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(10)))).drop("again")
    one, more = hypervectors.train(d, 300), hypervectors.train(ten, 300)
    assert one[0] == more[0] and np.allclose(one[1], more[1], atol=1e-5)  # the same ids are drawn
