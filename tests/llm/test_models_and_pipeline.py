"""Nearest neighbours, mixtures, the language model and the pipeline against plain versions."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from threatloom.llm import hnsw, mixing, pitman_yor, simhash

SF = "/root/testdata/sf0.001"


def test_nearest(spark):
    random.seed(1)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(600)]
    rows += [(i, rows[5][1], 0) for i in range(600, 660)] + [(660, None, 0), (661, [0.0] * 16, 0), (662, [math.nan] * 16, 0), (663, [None] * 16, 0), (None, [1.0] * 16, 0), (664, [1.0, 2.0], 0), (665, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found = hnsw.nearest(table, table.filter("vec_id % 50 = 0 OR vec_id = 664"), shard_rows=150).collect()
    ids = np.array([r[0] for r in rows[:660]])
    vectors = np.array([r[1] for r in rows[:660]])
    hits = total = 0
    for q in range(0, 660, 50):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        want = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11)) and all(abs(r["score"] - far[r["vec_id"]]) < 1e-12 for r in got)
        hits, total = hits + len({r["vec_id"] for r in got} & set(want)), total + 10
    assert hits / total >= 0.95
    assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == 600), key=lambda r: r["rank"])] == [5, *range(601, 610)]
    assert not [r for r in found if r["query_id"] == 664] and hnsw.nearest(table.limit(0), table.limit(0)).count() == 0


def test_nearest_at_any_magnitude(spark):
    rng = np.random.default_rng(3)
    plain = rng.normal(size=(60, 8))
    for size in (1e20, 1e-25, 1e200, 1e-200, 1e307):
        rows = [(i, (v * size / 4).tolist()) for i, v in enumerate(plain)] + ([(60, [1e30] * 8)] if size < 1 else [])
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = hnsw.nearest(table, table.filter("vec_id = 0")).orderBy("rank").collect()
        far = np.sqrt(((plain - plain[0]) ** 2).sum(axis=1)) / 4
        assert [r["vec_id"] for r in found] == [i for i in np.argsort(far) if i][:10]
        assert all(abs(r["score"] / size - far[r["vec_id"]]) < 1e-12 for r in found)


def test_turns_and_names_of_a_mixture(spark):
    rows = [(i, "w " * (1 + i % 5), "abc"[i % 7 % 3], i, "x", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy long, rest__plan string, turn int")
    got = mixing.mix(docs, repeats=1.5, block_tokens=100)
    assert got.columns == [*docs.columns, "copy_", "turn_"] and got.filter("copy <> doc_id").count() == 0
    turns = [(r["turn_"], r["source"]) for r in got.collect()]
    assert len({t for t, _ in turns}) == len(turns)
    ordered = [s for _, s in sorted(turns)]
    share, early = Counter(ordered), Counter(ordered[: len(ordered) // 2])
    assert all(abs(early[s] / len(ordered) * 2 - share[s] / len(ordered)) < 0.1 for s in share)


def test_mixture(spark):
    rows = [(i, f"{i} " + "w " * (i % 7), "big" if i < 700 else "mid" if i < 900 else None, 0) for i in range(1000)]
    docs = spark.createDataFrame(rows + [(2000, "", "empty", 0), (2001, None, "empty", 0)], "doc_id long, text string, source string, size int")
    tokens = {i: 1 + i % 7 for i in range(1000)}
    once = mixing.mix(docs, repeats=1.5, block_tokens=200).collect()
    drawn = Counter(r["doc_id"] for r in once)
    assert set(drawn) == set(range(1000)) | {2000, 2001} and drawn[2000] == 1
    share = Counter()
    for r in once:
        share[r["source"]] += tokens.get(r["doc_id"], 0)
    own = {s: sum(t for i, t in tokens.items() if rows[i][2] == s) for s in ("big", "mid", None)}
    assert share["big"] == own["big"] and 1.45 * own[None] < share[None] <= 1.5 * own[None] + 1
    half = mixing.mix(docs, entropy=1.0, budget=0.5, block_tokens=200).collect()
    total = sum(tokens.values())
    got = Counter()
    for r in half:
        got[r["source"]] += tokens.get(r["doc_id"], 0)
    drawn_all = sum(got.values())
    assert 0.5 * total - 3 * 8 <= drawn_all <= 0.5 * total + 2
    weights = [got[s] / drawn_all for s in own]
    assert abs(-sum(w * math.log(w) for w in weights) - 1.0) < 0.02
    assert sorted(map(tuple, half)) == sorted(map(tuple, mixing.mix(docs, entropy=1.0, budget=0.5, block_tokens=200).collect())) if all(r["source"] for r in half) else True
    assert mixing.mix(docs.limit(0), repeats=1.5).count() == 0


def test_language_model(spark):
    random.seed(2)
    nxt = {w: random.sample("abcdefgh", 2) for w in "abcdefgh"}

    def text():
        out = ["a"]
        for _ in range(60):
            out.append(random.choice(nxt[out[-1]]))
        return " ".join(out)

    texts = [text() for _ in range(80)] + ["", None, "unseen words only", "A " * 4000]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, held int")
    found = {r["doc_id"]: r for r in pitman_yor.score(docs, F.col("doc_id") % 4 == 1).collect()}
    learnt = Counter()
    for i, t in enumerate(texts):
        if i % 4 != 1:
            learnt.update([*(t or "").lower().split(), "\n"])
    n, v = sum(learnt.values()), len(learnt)
    for i, t in enumerate(texts):
        seq = [*(t or "").lower().split(), "\n"]
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(seq), sum(learnt[w] > 0 for w in seq), n, i % 4 == 1)
        assert abs(r["base_score"] - sum(math.log10((learnt[w] + 1) / (n + v + 1)) for w in seq)) < 1e-6
    held = [i for i in range(80) if i % 4 == 1]
    assert sum(found[i]["score"] for i in held) > 0.75 * sum(found[i]["base_score"] for i in held)
    assert pitman_yor.score(docs.limit(0), F.lit(False)).count() == 0


def test_predictive_probabilities_sum_to_one():
    word = np.array([0, 1, 2, 0, 1, 2])
    context = np.array([0, 0, 0, 1, 1, 1])
    customers = np.array([5, 2, 1, 1, 7, 0])
    s = pitman_yor.Sampler(word, context, customers, 3, np.ones(2), 1 / 4, 0)
    for _ in range(20):
        s.sweep()
        assert s.leaf.customers.tolist() == customers.tolist() and s.root.customers.sum() == len(s.leaf.dish)
        assert np.bincount(s.leaf.dish, s.leaf.size, 6).tolist() == customers.tolist()
    chance = s.root_chance(np.arange(3), s.root.tables(), float(s.root.customers.sum()), len(s.root.dish))
    d, t = pitman_yor.DISCOUNTS[0], pitman_yor.STRENGTHS[0]
    rest = (t + d * len(s.root.dish)) / 4 / (t + s.root.customers.sum())
    assert abs(chance.sum() + rest - 1) < 1e-12


def test_stirling_numbers_and_draws():
    for d in pitman_yor.DISCOUNTS:
        exact = np.full((601, 601), -np.inf)
        exact[1, 1] = 0
        for c in range(1, 600):
            t = np.arange(1, c + 2)
            stay = np.log(np.maximum(c - t * d, 1e-300)) + exact[c, 1 : c + 2]
            exact[c + 1, 1 : c + 2] = np.logaddexp(np.where(t <= c, stay, -np.inf), exact[c, : c + 1])
        for c in (40, 300, 600):
            t = np.arange(1, c + 1)
            if c > pitman_yor.EXACT:
                assert np.abs(pitman_yor.STIRLING[d](np.array([[c]]), t[None, :])[0] - exact[c, 1 : c + 1]).max() < 0.1
            for opening in (0.2, 9.0, 120.0):
                w = exact[c, 1 : c + 1] + t * np.log(opening)
                weight = np.exp(w - w.max())
                mean = (weight * t).sum() / weight.sum()
                spread = np.sqrt((weight * t * t).sum() / weight.sum() - mean**2)
                drawn = pitman_yor.draw_tables(np.random.default_rng(3), d, np.full(2000, c), np.full(2000, 1e12), None, np.full(2000, 1e12 * d / opening))
                assert abs(drawn.mean() - mean) < 5 * spread / np.sqrt(2000) + 0.01 * mean


def test_hot_dishes_leave_one_table():
    """All customers of a dish are seated anew at once, so 13 sweeps are enough however many they are."""
    rise, over = np.full(300, 1e12), np.full(300, 1e12 * 0.8 / 47)
    for c in (1_000, 10_000, 1_000_000):
        assert 54 < pitman_yor.draw_tables(np.random.default_rng(5), 0.8, np.full(300, c), rise, None, over).mean() < 66
    customers = np.array([1_000, 10_000, 1_000_000])
    s = pitman_yor.Sampler(np.arange(3), np.zeros(3, int), customers, 3, np.ones(1), 1 / 4, 5)
    for _ in range(13):
        s.sweep()
    assert s.leaf.tables().min() >= 10


def test_every_word_is_a_context(spark, monkeypatch):
    """What follows a rare word is learnt, and counts of customers and tables meet over partitions."""
    monkeypatch.setattr(pitman_yor, "PART_TOKENS", 9_000)
    random.seed(6)
    pairs = [(f"a{i}", f"b{i}") for i in range(3000)]

    def text():
        return " ".join(w for pair in random.sample(pairs, 60) for w in pair)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    found = pitman_yor.score(docs, F.col("doc_id") % 8 == 1).collect()
    held = [r for r in found if r["held_out"]]
    # Half of the words follow from the one before, the other half are one of 3,000.
    per_token = -sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert len(found) == 400 and per_token < 0.75 * -sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)


def test_pipeline_keeps_one_of_each_group_and_only_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name == "near duplicates":
            groups = {r[0] for r in simhash.near_duplicates(before).select("component_id").distinct().collect()}
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(groups)
        if name == "source mixture":
            assert after.select("doc_id").distinct().count() == before.count() <= after.count()
        if name != "tokens":
            assert after.columns == docs.columns
            path = corpus_pipeline.kept_in_table(after, "stage")
            before = path
    assert after.filter("NOT exact").count() == 0 and after.count() == before.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id").exceptAll(after.select("doc_id")).count() == 0
