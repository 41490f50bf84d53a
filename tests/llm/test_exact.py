"""Results against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bit_codes, bpe, common, cotraining, hypervectors, packing, parity_join, pii_crf, registry, rule_forest, shards

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_op1_and_op3_tell_bad_documents_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    for found in (cotraining.score(d, cotraining.train(d, fit)), rule_forest.judge(d, rule_forest.train(d, fit)).withColumn("kept", F.col("kept") | (F.col("base_failed") & (F.col("n_words") < 50)))):
        rows = found.select("doc_id", "kept").join(held, "doc_id").select("quality", "kept").collect()
        good = [r["kept"] for r in rows if r["quality"] == 1]
        bad = [r["kept"] for r in rows if r["quality"] == 0]
        assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_views_exchange_labels():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400)
    a = (y[:, None] * 2 - 1) * 1.5 + r.standard_normal((400, 4))
    b = (y[:, None] * 2 - 1) * 1.5 + r.standard_normal((400, 3))
    m = cotraining.cotrain(a[:60].astype(np.float32), b[:60].astype(np.float32), y[:60], a[60:300].astype(np.float32), b[60:300].astype(np.float32))
    assert min(m.taken) > 0
    s = m.scores(a[300:].astype(np.float32), b[300:].astype(np.float32))[2]
    assert ((s > 0.5) == y[300:]).mean() > 0.9


def test_pseudo_labels_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "TAKEN", 7)
    r = random.Random(1)
    prose = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    good, bad = "the cat sat on a warm mat and went away".split(), "BUY!!! 99$ now4 FREE>>> click# x9x".split()
    rows = [(i, prose(good if i % 2 else bad, 40), "s", "en") for i in range(200)] + [(1000 + i, prose(good if i % 2 else bad, 40), "s", "en") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, inner = [], cotraining.surest_of
    monkeypatch.setattr(cotraining, "surest_of", lambda pool, *a: seen.append((pool.orderBy("row").collect(), a, inner(pool, *a))) or seen[-1][2])
    model = cotraining.train(d, labels, rounds=2)
    rows, (views, odds, known), got = seen[-1]
    assert len(rows) == 6000 and len(seen) == 2 and max(model.taken) == 2 * 2 * 7
    # the best of the second round, by hand
    x = [cotraining._matrix(rows, "content", 1028), cotraining._matrix(rows, "meta", cotraining.META)]
    keys, ids = np.array([q["row"] for q in rows]), np.array([q["doc_id"] for q in rows])
    for k, (sure, at) in cotraining.sure_rows(views, odds, known, x, keys).items():
        want = [p for _, p in sorted(zip(-sure, at), key=lambda t: (t[0], ids[t[1]]))][:7]
        assert len(got[k]) == min(7, len(at))
        p = lambda rows_: [cotraining.sigmoid(odds[k[0]][0] * views[k[0]](x[k[0]][rows_]) + odds[k[0]][1])]
        assert np.allclose(p(want), p([int(np.flatnonzero(keys == q[0])[0]) for q in got[k]]), atol=1e-5)
        assert not {q[0] for q in got[k]} & set(known[1 - k[0]])


def test_logistic_is_at_the_optimum():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 5))
    y = (x[:, 0] + 0.5 * r.standard_normal(300) > 0).astype(float)
    f = cotraining.logistic(x, y, 1e-2, 3000)
    p = 1 / (1 + np.exp(-(x @ f.w + f.b)))
    assert np.abs(x.T @ (p - y) / 300 + 1e-2 * f.w).max() < 1e-4 and abs((p - y).mean()) < 1e-4


def test_op1_scores_by_hand(spark, docs):
    """The same views trained on the driver, with all documents in memory."""
    labels = {}
    for r in spark.read.parquet(f"{D}/labels.parquet").collect():
        if r["quality"] is not None:
            labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    rows, cache = sorted(docs.collect(), key=lambda r: r["doc_id"]), cotraining.Word()
    half = lambda x: x.astype(np.float16).astype(np.float32)
    c = np.stack([half(cotraining.content(r["text"], cache)) for r in rows])
    m = np.stack([half(cotraining.metadata(r["source"], r["lang"], r["text"])) for r in rows])
    known = np.array([r["doc_id"] in labels for r in rows])
    y = np.array([float(labels[r["doc_id"]] > 0) for r in rows if r["doc_id"] in labels], np.float32)
    model = cotraining.cotrain(c[known], m[known], y, c[~known], m[~known])
    want = dict(zip([r["doc_id"] for r in rows], model.scores(c, m)[2], strict=True))
    got = {r["doc_id"]: r for r in cotraining.op1_cotraining(spark, D).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i]["score"] - want[i]) for i in want) < 1e-3
    assert all(got[i]["kept"] == (got[i]["score"] >= model.cut) for i in want if abs(want[i] - model.cut) > 1e-3)


def test_op3_verdicts_by_hand(spark, texts):
    """Paths walked node by node, and the threshold by trying every score."""
    labels = {}
    for r in spark.read.parquet(f"{D}/labels.parquet").collect():
        if r["quality"] is not None and r["doc_id"] in texts:
            labels[r["doc_id"]] = min(r["quality"], labels.get(r["doc_id"], 1))
    x = {i: np.array(rule_forest.statistics(t)[1]) for i, t in texts.items()}
    ids = sorted(labels)
    forest = rule_forest.fit(np.array([x[i] for i in ids]), np.array([labels[i] > 0 for i in ids]))

    def score(row):
        total = 0.0
        for f, c, left, path in zip(forest.feature, forest.cut, forest.left, forest.path):
            at = 0
            while f[at] >= 0:
                at = left[at] + (row[f[at]] >= c[at])
            total += path[at]
        return 2 ** (-total / len(forest.feature) / forest.expected)

    s = {i: score(row) for i, row in x.items()}
    good, bad = [s[i] for i in ids if labels[i] > 0], [s[i] for i in ids if labels[i] == 0]
    floor = float(np.quantile(good, rule_forest.KEEP))
    best = max((np.mean(np.array(bad) > c) - 4 * np.mean(np.array(good) > c) for c in [*good, *bad] if c >= floor), default=None)
    assert best == pytest.approx(np.mean(np.array(bad) > forest.threshold) - 4 * np.mean(np.array(good) > forest.threshold))
    for r in rule_forest.op3_rules(spark, D).collect():
        assert r["anomaly"] == pytest.approx(s[r["doc_id"]])
        assert r["kept"] == (not r["base_failed"] and s[r["doc_id"]] <= forest.threshold + 1e-12)


def test_op3_base_statistics(texts):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for t in [*texts.values(), "a b c a b c", "a a a a", "x\n\nx\n x", "a b c d a b", " \x1c\x85 "]:
        words = word.findall(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        again = {w for w in windows if windows.count(w) > 1} if len(windows) < 400 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
        marked = {i + j for i, w in enumerate(windows) if w in again for j in range(3)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if word.search(line):
                dup += line in seen
                seen.add(line)
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)]
        assert rule_forest.statistics(t)[0] == want


def test_op2_plan_is_the_smallest_capacity(spark, monkeypatch):
    r = random.Random(2)
    for large in (16_384, 20, 3):
        monkeypatch.setattr(shards, "LARGE", large)
        rows = list({r.randrange(1 << 60): r.choice([1, r.randint(1, 50), r.randint(1, 5000)]) for _ in range(800)}.items())
        by_key, begins, capacity = shards.plan(spark.createDataFrame(rows, "key long, size long"), 16)
        total = sum(s for _, s in rows)
        line = sorted([x for x in rows if x[1] * large > total], key=lambda x: (-x[1], x[0])) + sorted(x for x in rows if x[1] * large <= total)

        def greedy(c):
            out, held, at = [], 0, 0
            for _, s in line:
                if held + s > c:
                    at, held = at + 1, 0
                held += s
                out.append(at)
            return out if at < 16 and max(s for _, s in line) <= c else None

        best = next(c for c in range(-(-total // 16), total + 1) if greedy(c))
        assert best == capacity
        assert greedy(best) == [by_key[k] if k in by_key else sum(b <= k for b in begins) for k, _ in line]


def test_op4_finds_what_brute_force_finds(spark):
    v = spark.read.parquet(f"{D}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in v.collect()}
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    got = {}
    for r in bit_codes.op4_nearest(spark, D).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert r["score"] == pytest.approx(float(rows[r["query_id"]] @ rows[r["vec_id"]]), abs=1e-12)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ rows[q]
        want = {int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q}
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit, total = hit + len(set(best) & set(got[q].values())), total + 20
        assert sorted(got[q]) == list(range(1, 21)) and set(got[q].values()) <= want
    assert hit / total > 0.99


def test_op4_blocks_agree(spark, monkeypatch):
    v = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding")
    ask = v.where("vec_id % 20 = 0")
    one = sorted(map(tuple, bit_codes.nearest(v, ask, 20).collect()))
    monkeypatch.setattr(bit_codes, "BLOCK", 120)
    monkeypatch.setattr(bit_codes, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, bit_codes.nearest(v, ask, 20).collect())) == one


def test_op4_repeated_queries_and_lengths_of_the_candidates(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = spark.createDataFrame([(10, [10.0, 1.0]), (10, [10.0, 1.0]), (3, [3.0]), (4, [4.0])], v.schema)
    got = [(r["query_id"], r["rank"], r["id"]) for r in bit_codes.nearest(v, twice, 5).orderBy("rank").collect()]
    assert got == [(10, k, i) for k, i in enumerate([11, 9, 8, 7, 6], 1)]
    other = spark.createDataFrame([(10, [10.0, 1.0]), (10, [-10.0, 1.0])], v.schema)
    got = sorted((r["score"], r["rank"], r["id"]) for r in bit_codes.nearest(v, other, 2).collect())
    assert [x[1:] for x in got] == [(2, 2), (1, 1), (2, 9), (1, 11)]


def test_op4_estimates_are_products_of_packed_bits():
    r = np.random.default_rng(0)
    q, signs = r.standard_normal((9, 256)), r.integers(0, 2, (50, 256))
    got, lost = bit_codes._products(q, np.ascontiguousarray(bit_codes._words(signs > 0).T))
    want = q @ (signs.T * 2 - 1)
    assert (np.abs(got - want) <= 4 * lost[:, None]).all() and (lost < 0.15 * np.linalg.norm(q, axis=1)).all()


def test_op5_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    got = hypervectors.op5_language(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_op5_vector_of_a_text():
    letters = hypervectors.Letters(64)
    v = lambda c: np.random.default_rng((hypervectors.SEED, c + 1)).integers(0, 2, 64) * 2 - 1
    n = [-1, ord("a"), ord("b"), -1, ord("c"), -1]
    want = sum(np.roll(v(x), 2) * np.roll(v(y), 1) * v(z) for x, y, z in zip(n, n[1:], n[2:]))
    assert (letters.bundles(["Ab, 12 c!"])[0] == want).all()


def test_op5_predictions_by_hand(spark, docs, texts):
    rows = docs.where("crc32(cast(doc_id AS string)) % 4 <> 2 AND lang IS NOT NULL").collect()
    letters = hypervectors.Letters()
    sums = {}
    for r in rows:
        v = letters.bundles([r["text"]])[0].astype(float)
        sums[r["lang"]] = sums.get(r["lang"], 0) + v / max(1e-9, np.linalg.norm(v))
    names = sorted(sums)
    for r in hypervectors.op5_language(spark, D).collect():
        v = letters.bundles([texts[r["doc_id"]]])[0]
        near = [float(v @ sums[g]) / np.linalg.norm(v) / np.linalg.norm(sums[g]) for g in names]
        assert r["lang_pred"] == names[int(np.argmax(near))] and r["score"] == pytest.approx(max(near), abs=1e-4)


def test_op5_slices_change_nothing(monkeypatch):
    r = random.Random(4)
    texts = ["".join(chr(r.choice([97, 98, 99, 32, 0x4E00 + r.randrange(3000)])) for _ in range(r.randint(0, 4000))) for _ in range(20)] + [None, "", "12"]
    whole = hypervectors.Letters(64).bundles(texts)
    for name, n in (("SLICE", 50), ("LETTERS", 999), ("GROUP", 3), ("KEPT", 10)):
        monkeypatch.setattr(hypervectors, name, n)
    assert (hypervectors.Letters(64).bundles(texts) == whole).all()


def test_op6_pieces_are_the_documents(spark, texts):
    t = Tokenizer.from_file(bpe.default_path())
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    held, seqs = {}, {}
    for r in packing.op6_packing(spark, D).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and len(part) == r["length"]
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, full in [*((p, len(ids[i])) for i, p in held.items()), *((p, None) for p in seqs.values())]:
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end == full or full is None and (end == 4096 or end & (end - 1) == 0)
    assert held.keys() == ids.keys()


def test_op6_plan_keeps_the_mixture():
    r = random.Random(3)
    for k in range(60):
        tokens = [r.choice([0, 1, 255, 256, 4096, r.randint(0, 60_000)]) for _ in range(r.randint(1, 8))]
        p = packing.Plan(tokens, None if k % 2 else [r.choice([0, 1, 3]) for _ in tokens])
        seqs = {}
        for q, t in enumerate(tokens):
            at = 0
            while at < t:
                n = min(r.randint(1, 3000), t - at)
                assert sum(x[1] for x in p.pieces(q, at, n)) == n
                for _, m, s, off in p.pieces(q, at, n):
                    seqs.setdefault(s, []).append((off, m, q))
                at += n
        assert sorted(seqs) == list(range(len(seqs)))
        slices, sent = sum(t // 256 for t in tokens), [0] * len(tokens)
        for s in sorted(seqs):
            end = 0
            for off, m, q in sorted(seqs[s]):
                assert off == end
                end, sent[q] = end + m, sent[q] + m
            assert end == 4096 or end & (end - 1) == 0
            if k % 2 and p.phases and s < p.phases[0].rounds - 1:
                assert all(abs(sent[q] / 256 - (s + 1) * 16 * (t // 256) / slices) <= len(tokens) for q, t in enumerate(tokens))


def test_op6_counters_round_by_round():
    """What a queue has sent after any round is what a counter, stepped round by round, has let through."""
    r = random.Random(11)
    for _ in range(40):
        tokens = [r.randint(0, 90_000) for _ in range(r.randint(1, 7))]
        plan = packing.Plan(tokens, None if r.random() < 0.5 else [r.randint(0, 4) for _ in tokens])
        for phase in plan.phases:
            counter, sent = [0] * len(phase.queues), [0] * len(phase.queues)
            for turn in range(phase.rounds):
                order = []
                for i, g in enumerate(phase.gain.tolist()):
                    counter[i] += g
                    n, counter[i] = divmod(counter[i], phase.total)
                    order += [i] * n
                    sent[i] += n
                assert sent == phase.after(turn + 1).tolist()
                for k, i in enumerate(order):  # the place of each slice of the round
                    before = sum(phase.after(turn).tolist()) + k
                    own = phase.sent[phase.queues[i]][1] + phase.after(turn)[i] + order[:k].count(i)
                    assert plan.run(phase.queues[i], plan.of[phase.queues[i]], int(own) * plan.slice)[0] == (phase.first + before) * plan.slice


def brute_components(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op7_components(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.op7_parity_join(spark, D).collect()}
    assert got == brute_components(texts, 4, 85, 100)


@pytest.mark.parametrize("width, num", [(4, 85), (5, 80)])
def test_join_of_a_family_of_edits(spark, monkeypatch, width, num):
    monkeypatch.setattr(parity_join, "BLOCK", 16)
    r = random.Random(width)
    base = [f"w{i}" for i in range(120)]
    rows = {}
    for i in range(150):
        w = list(base[: r.choice([5, 6, 9, 14, 30, 60, 120])])
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(400)}"
        rows[i] = " ".join(w)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x["id"]: (x["n_shingles"], x["component_id"]) for x in parity_join.near_duplicates(d, width, num, 100).collect()}
    assert got == brute_components(rows, width, num, 100)


def test_join_of_large_meetings_in_blocks(spark, monkeypatch):
    """Copies of one text that mostly link through it alone, in many blocks, and some that don't link at all."""
    monkeypatch.setattr(parity_join, "BLOCK", 12)
    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = {1000: " ".join(base)}
    for i in range(160):
        w = list(base)
        for j in r.sample(range(300), r.choice([3, 4, 5, 6, 7, 8, 9, 10])):
            w[j] = f"z{i}.{j}"
        rows[i] = " ".join(w)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {x["id"]: (x["n_shingles"], x["component_id"]) for x in parity_join.near_duplicates(d, 5, 80, 100).collect()}
    want = brute_components(rows, 5, 80, 100)
    assert got == want
    assert 1 < len(set(c for _, c in want.values())) < 100


def template_pages(n):
    r = random.Random(n)
    base = [f"w{i}" for i in range(395)]
    fields = [20 + 47 * k for k in range(8)]
    out = {}
    for i in range(n):
        w = list(base)
        for f in fields:
            w[f] = f"v{r.randrange(10**9)}"
        out[i] = " ".join(w)
    return out


def test_rows_of_a_family_without_links_grow_with_its_documents(spark, monkeypatch):
    made, inner = [], parity_join.by_cell

    def counted(rows, *rest):
        out = inner(rows, *rest)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(parity_join, "by_cell", counted)
    each = {}
    for n in (200, 400, 800):
        made.clear()
        rows = template_pages(n)
        d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        got = {x["id"]: (x["n_shingles"], x["component_id"]) for x in parity_join.near_duplicates(d, 4, 85, 100).collect()}
        if n == 200:
            assert got == brute_components(rows, 4, 85, 100)
        assert all(c == i for i, (_, c) in got.items())
        each[n] = [sum(x) / n for x in zip(*made)]
    assert each[800][0] < 1.2 * each[200][0] + 5 and each[800][1] < 1.2 * each[200][1] + 5, each


def test_signatures_of_very_many_documents_are_passed_on(monkeypatch):
    monkeypatch.setattr(parity_join, "GATHERED", 400)
    r = np.random.default_rng(1)
    keys = np.concatenate([np.full(900, 5 << 12, np.uint64), r.integers(0, 120, 700).astype(np.uint64) << np.uint64(13)])
    ids = np.arange(len(keys))
    order = r.permutation(len(keys))
    got, rows = parity_join.Gathered(), []
    for at in range(0, len(keys), 37):
        for b in got.add(keys[order[at : at + 37]], ids[order[at : at + 37]]):
            rows += b.to_pylist()
    for b in got.close():
        rows += b.to_pylist()
    named = {x["id"] for x in rows if x["g2"] == parity_join.NAMED}
    assert named == set(range(900)) and all(x["size"] == 0 for x in rows if x["id"] in named)
    sets = {}
    for x in rows:
        if x["g2"] != parity_join.NAMED:
            sets.setdefault((x["g1"], x["g2"]), set()).add(x["id"])
    want = {}
    for k, i in zip(keys[900:].tolist(), ids[900:].tolist()):
        want.setdefault(k, set()).add(i)
    assert sorted(map(sorted, sets.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_join_of_rows_without_ids_and_of_hot_keys(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w59", "end")
    rows = [(None, text), (None, text), (7, near), (None, "of its own " * 3), (None, "of its own " * 3), (8, None), (None, None), (5, near), *((100 + i, text) for i in range(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "SMALL_ROWS", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    got = parity_join.near_duplicates(d, 5, 80, 100).collect()
    assert len(got) == len(rows)
    alone = [r for r in got if r["n_shingles"] not in (0, 56)]
    assert len(alone) == 2 and all(r["component_id"] is None and r["id"] is None for r in alone)
    assert {r["component_id"] for r in got if r["n_shingles"] == 56} == {5}
    assert {r["id"]: r["links"] for r in got if r["id"] in (5, 7, 100)} == {5: 2, 7: 1, 100: 22}
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in parity_join.keep_one(d, 5, 80, 100).collect())
    assert kept == [(0, ""), (0, "of its own " * 3), (5, near), (8, "")]


def test_partners_share_a_signature_and_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for num in (85, 80):
        bands = parity_join.Bands(num, 100)
        for _ in range(400):
            n = int(r.integers(1, 400))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            cut = int(r.integers(0, max(1, n // 8) + 1))
            b = np.unique(np.concatenate([a[cut:], r.integers(0, 2**63, int(r.integers(0, cut + 1))).astype(np.uint64)]))
            if not len(b):
                continue
            same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            keys = [np.concatenate([parity_join.signatures(x, band, d) for band, d, _ in bands.of(len(x))]) for x in (a, b)]
            if 100 * same >= num * union:
                assert len(np.intersect1d(*keys))
            s = parity_join.folded([parity_join.sketch(a, 256), parity_join.sketch(b, 1024)])
            assert np.bitwise_count(s[0] ^ s[1]).sum() <= union - same


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["label"] for r in parity_join.components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def test_op8_equals_the_library(spark, texts):
    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.op8_bpe(spark, D).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tree_concatenation_equals_the_library():
    t, e, r = Tokenizer.from_file(bpe.default_path()), bpe.encoder(bpe.default_path()), random.Random(1)
    for k in range(40):
        letters = r.choice(["ab", "aaab", "theingtion", "abcdefghijklmnopqrstuvwxyz", "a", "éß", "!?.", "日本語"])
        x = "".join(r.choice(letters) for _ in range(r.randint(2000, 30_000)))
        x = f"hi <|endoftext|>{x} \xa0 there{x[:3000].upper()}" if k % 4 == 0 else x
        assert t.encode(x, add_special_tokens=False).ids == e.encode(x).tolist()
    parts = ["a", "the", "ß", "É", "!!", "0", "é", "日本", "́", "İ", "Σ", "'s", "'LL", " ", "\n", "\x0b", "\x85", "\xa0", "<|endoftext|>", "<|", "🙂", "ŉ", "²", "\x1c", "\x00"]
    for _ in range(800):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        ids = t.encode(x, add_special_tokens=False).ids
        assert ids == e.encode(x).tolist() and t.decode(ids, skip_special_tokens=False) == e.decode(ids)


def test_documents_are_joined_from_leaves(texts):
    t, e = Tokenizer.from_file(bpe.default_path()), bpe.Encoder(bpe.default_path())
    for x in texts.values():
        assert e.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert e.joins > sum(len(x) > bpe.LEAF for x in texts.values())
    r = random.Random(8)
    parts = ["a", "the", "ß", "É", "!!", "0", "é", "日本", "\u0301", "İ", "Σ", "'s", "'LL", "'", "r", "e", "ve", "l", " ", " ", "\n", "\x0b", "\xa0", "<|endoftext|>", "<|", "🙂", "ŉ", "\x1c", "\x00", "don", "theing", "."]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert e.encode(x, r.choice([1, 2, 3, 5, 8, 13, 30])).tolist() == t.encode(x, add_special_tokens=False).ids


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(*m.span(), 0) for m in EMAIL.finditer(t)]
    out += [(*m.span(), 1) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_op10_base_spans(spark, texts):
    r = random.Random(7)
    for _ in range(3000):
        x = "".join(r.choice(["a", "1", "23", ".", "@", "-", "+", " ", "(", ")", "b.c", "x@y.z", "1.2.3.4", "é", "\n", "255", "4111111111111111", "%"]) for _ in range(r.randint(1, 25)))
        assert pii_crf.base_spans(x) == plain_spans(x)
    for row in pii_crf.op10_personal_data(spark, D).collect():
        want = plain_spans(texts[row["doc_id"]])
        assert row["base_sha256"] == hashlib.sha256(pii_crf.named(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii_crf.KINDS[:4]] == [sum(s[2] == i for s in want) for i in range(4)]
        assert row["n_found"] == len([x for c in ("spans", "secrets") for x in row[c].split(",") if x])
        assert set(filter(None, pii_crf.named(want).split(","))) <= set(row["spans"].split(","))


def test_op10_field_on_unseen_sentences():
    field, r = pii_crf.trained(), random.Random(99)
    right = wrong = missed = 0
    for _ in range(300):
        text, gold = pii_crf._sentence(r)
        base, spans = pii_crf.find_spans(text, field)
        right += len(set(spans) & set(gold))
        wrong += len(set(spans) - set(gold) - set(base))
        missed += sum(not any(s < b and e > a for s, e, _ in spans) for a, b, _ in gold)
    assert right > 250 and wrong < 0.03 * right and missed < 0.05 * right


def test_op10_every_written_entity_is_a_candidate():
    r = random.Random(7)
    for _ in range(1500):
        text, gold = pii_crf._sentence(r)
        seen = set(pii_crf.base_spans(text))
        for a, b in pii_crf.stretches(text, []):
            tokens, segments = pii_crf.lattice(text, a, b)
            seen |= {(tokens[s.begin][0], tokens[s.end - 1][1], s.kind) for s in segments}
        assert set(gold) <= seen, text


@pytest.mark.parametrize("entity, kind", [("8[.]8[.]8[.]8", 1), ("10[.]0[.]0[.]1", 1), ("1 . 1 . 1 . 1", 1), ("10(.)0(.)0(.)1", 1), ("john.smith (at) mail.example (dot) com", 0), ("a.b (at) host1 (dot) com", 0), ("john.smith (at) mail.example (dot) co (dot) uk", 0)])
def test_op10_short_addresses_and_long_spelt_ones(entity, kind):
    text = f"please use {entity} today"
    assert pii_crf.find_spans(text, pii_crf.trained())[1] == [(11, 11 + len(entity), kind)]


#: Sentences written by hand, entities in angle brackets with their kinds; none comes from the generator.
HAND = """
call <phone:5095556973> now
Phone: <phone:5095556973>
tel <phone:030 1234567> bitte
my number is <phone:(509) 555-6973> after six
ring <phone:509-555-6973> or <phone:509.555.6974>
fax <phone:0049 211 5684962>, please
reach me at <email:jane.doe (at) example (dot) org> today
write to <email:bob [at] mail [dot] example [dot] com>
mail <email:info @ example.org> instead
<email:press at museum dot example dot org> is read daily
card <card:4000 0566 5566 5557> declined
visa <card:4111111111111112> was refused
pay with <card:5500-0000-0000-0005> please
server <ip:10[.]0[.]0[.]12> is down
host <ip:192 . 168 . 1 . 20> answered
token = "<secret:49ab8b03847754d938118ecf003181de2dc09b88>" ok
api key: <secret:sk9f8a7b6c5d4e3f2a1b0c9d8e7f>
password=<secret:Tr0ub4dor3xKq92LmZ> here
plain <email:und.34@mail7.example.com> and <ip:97.51.17.173> and <phone:+1 (017) 555-7713> end
commit 49ab8b03847754d938118ecf003181de2dc09b88 fixed it
on 2024-05-17 and 17.05.2024 at 10:30
version 10.0.19041.1 of the tool
isbn 978-3-16-148410-0
order 8812345678 shipped
invoice 20240517 total $1234567.89
years 1998-2004, 2010-2015
we met at noon.today and left
pages 12-18, 20-25 and 31
"""


def test_op10_recall_on_sentences_written_by_hand():
    right = missed = wrong = 0
    for line in HAND.strip().split("\n"):
        text, gold = "", set()
        for part in re.split(r"(<[a-z]+:[^>]+>)", line):
            if m := re.fullmatch(r"<([a-z]+):([^>]+)>", part):
                gold.add((len(text), len(text) + len(m[2]), pii_crf.KINDS.index(m[1])))
                part = m[2]
            text += part
        found = set(pii_crf.find_spans(text, pii_crf.trained())[1])
        right, missed, wrong = right + len(found & gold), missed + len(gold - found), wrong + len(found - gold)
    assert right >= 22 and missed <= 1 and wrong <= 1, (right, missed, wrong)


@pytest.mark.parametrize("text", ["items 1 2 3 4 and 5", "1. 2. 3. 4. 5", "sections 1. 2. 3. 4 of", "rows 1-2-3-4-5-6", "10 .5 .2 .9 "])
def test_op10_short_lists_are_no_addresses(text):
    assert pii_crf.find_spans(text, pii_crf.trained())[1] == []


def test_op10_best_segmentation_is_the_best():
    field = pii_crf.trained()
    text = "call (509) 555-6973 or 4111 1111 1111 1112"
    for a, b in pii_crf.stretches(text, []):
        tokens, segments = pii_crf.lattice(text, a, b)
        best = field.best(len(tokens), segments)

        def every(at, kind):
            if at == len(tokens):
                return 0.0
            out = field.pair[kind, pii_crf.NONE] + every(at + 1, pii_crf.NONE)
            for s in segments:
                if s.begin == at:
                    out = max(out, field.pair[kind, s.kind] + field.score(s) + every(s.end, s.kind))
            return out

        at, kind, total = 0, pii_crf.NONE, 0.0
        for s in [*best, None]:
            stop = s.begin if s else len(tokens)
            while at < stop:
                total, kind, at = total + field.pair[kind, pii_crf.NONE], pii_crf.NONE, at + 1
            if s:
                total, kind, at = total + field.pair[kind, s.kind] + field.score(s), s.kind, s.end
        assert total == pytest.approx(every(0, pii_crf.NONE))


def test_pipeline_by_hand(spark, docs, texts):
    """The filtering stages on driver-side copies of their judgements; packing holds just what is left."""
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, kept, D))
    model = cotraining.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    cache = cotraining.Word()
    rows = [r for r in docs.collect() if cotraining._scored(model, cache, [r["text"]], [r["source"]], [r["lang"]])[2][0] >= model.cut]
    forest = rule_forest.train(spark.createDataFrame(rows, docs.schema), spark.read.parquet(f"{D}/labels.parquet"))
    rows = [r for r in rows if rule_forest.verdicts([r["text"]], forest)[3][0]]
    comp = brute_components({r["doc_id"]: r["text"] for r in rows}, 5, 80, 100)
    want = {i for i, (_, c) in comp.items() if c == i}
    assert {r["doc_id"] for r in kept.collect()} == want
    t = Tokenizer.from_file(bpe.default_path())
    total = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept.collect())
    assert corpus_pipeline.run(spark, D).agg(F.sum("length")).collect()[0][0] == total
    field = pii_crf.trained()
    for r in kept.collect():
        text, spans, out, at = texts[r["doc_id"]], pii_crf.find_spans(texts[r["doc_id"]], field)[1], "", 0
        for a, b, k in spans:
            if a >= at:
                out += text[at:a] + f"<{pii_crf.KINDS[k].upper()}>"
            at = max(at, b)
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df, want = registry.QUERIES[name](spark, D), con.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    text = lambda rows, of: sorted(tuple(str(r[c]) for c in of) for r in rows)
    assert text(df.collect(), cols) == text(want.fetchall(), [want.columns.index(c) for c in cols])
