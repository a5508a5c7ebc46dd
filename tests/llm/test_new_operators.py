"""Repeated passages, whitening and the Merkle manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import compare, tables
from pyspark.sql import functions as F

from threatloom.llm import merkle, queries, repeats, sql, whitening

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_sql_agrees(spark, name):
    ok, note = compare(queries.queries()[name](spark, SF), tables(SF), queries.oracle_sql()[name])
    assert ok, note


# ---- repeated passages -----------------------------------------------------------------------


def plain_repeats(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[i : i + window])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeat_rows(rng):
    word = lambda: rng.choice(["aa", "Aa", "b", "é", "cc", "日本", "d", "e", "f", "g"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (9, 14, 30, 60)]
    rows = [(3, None), (4, ""), (5, " \n "), (None, shared[3]), (None, shared[3])]
    for d in range(10, 90):
        rows.append((d, " \n".join(rng.choice([text(rng.randrange(25)), rng.choice(shared)]) for _ in range(rng.randrange(5)))))
    for d, source in ((100, 12), (101, 12), (2, 40), (102, 40)):
        words = (rows[source][1] or "").split()
        rows.append((d, " ".join(w if rng.random() > 0.05 else "zz" for w in words)))
    rows += [(7, "x " * 400), (8, "x " * 300), (9, "x y " * 200), (6, "x y " * 90)]  # periods
    rows += [rows[20]] * 3 + [(50, shared[2] + " " + shared[1]), (50, shared[2] + " q"), (1, shared[2]), (200, shared[3] + " " + shared[3])]
    return rows


@pytest.mark.parametrize(("window", "gram"), [(12, 5), (10, 10), (8, 1)])
def test_repeats(spark, window, gram):
    rows = repeat_rows(random.Random(window))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"kept": F.lit("k"), "spans": F.lit(1), "doc": F.lit(2), "own": F.lit(0), "version": F.lit(5)})
    found = repeats.without_repeats(docs, window=window, gram=gram)
    assert found.columns == ["doc_id", "text", "kept", "spans", "doc", "own", "version", "n_words_", "n_removed_", "kept_", "spans_"]
    got = [(r["doc_id"], r["n_words_"], r["n_removed_"], r["kept_"]) for r in found.filter("kept = 'k' AND doc = 2").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain_repeats(rows, window), key=key)


def test_spans_have_their_source(spark):
    rng = random.Random(2)
    body = [str(rng.random()) for _ in range(300)]
    rows = [(1, " ".join(body)), (2, " ".join(["p", "q", *body[40:260], "r"])), (3, "")]
    found = {r["doc_id"]: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[2]["spans"]] == [(2, 220 - 49, 1, 40)] and found[2]["kept"] == "p q r"
    assert found[1]["spans"] == [] and found[1]["n_removed"] == 0 and found[3]["kept"] == ""


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(none, window=10, gram=11)


# ---- whitening -------------------------------------------------------------------------------


def plain_whitening(vectors, count):
    x = np.floor(256 * vectors).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    centred = u - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("shape", [(300, 12), (7, 3), (4, 9)])
def test_whitening(spark, shape):
    rng = np.random.default_rng(shape[0])
    vectors = rng.normal(size=shape) * np.linspace(3, 1, shape[1])
    vectors = np.vstack([vectors, vectors[:2]])
    d = shape[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist(), 0)]
    bad = [None, [], [None] * d, [math.nan] * d, [math.inf] * d, [1.0] * (d + 1)]
    table = spark.createDataFrame(rows + [(900 + i, v, 0) for i, v in enumerate(bad)], "vec_id long, embedding array<double>, x int").repartition(3)
    found = whitening.whiten(table).orderBy("vec_id", "component").collect()
    k = min(4, d, shape[0] - 1)
    n, deviation, white, explained = plain_whitening(vectors, k)
    assert len(found) == k * (len(vectors) + 1) and {r["vec_id"] for r in found} == {None, *range(len(vectors))}
    own = [r for r in found if r["vec_id"] is not None]
    got = np.array([r["whitened"] for r in own]).reshape(-1, k)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-11
    assert [r["deviation"] for r in own] == np.repeat(deviation, k).tolist() and {r["n"] for r in found} == {n}
    assert np.abs(np.array([r["explained"] for r in own[:k]]) / explained - 1).max() < 1e-12
    assert {r["identity_error"] for r in found} == {own[0]["identity_error"]} and own[0]["identity_error"] < 1e-12


def test_whitening_of_equal_directions(spark):
    """Equal eigenvalues: any orthonormal basis of their space will do, but all of it must be found."""
    rows = [(2 * i + s, [(1.0 if s else -1.0) * (i == j) for j in range(6)]) for i in range(6) for s in (0, 1)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 48 and found[0]["identity_error"] < 1e-12 and all(abs(r["explained"] - 1 / 6) < 1e-12 for r in found)


def test_whitening_of_nothing(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0


def test_deviation_at_the_edge_of_a_long(spark):
    rows = [(1, [2.0**22, 0.0]), (2, [-(2.0**22), 1.0]), (3, [2.0**40, 0.0])]
    found = {r["vec_id"]: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), count=1).collect()}
    x = [[int(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    for (i, _), v in zip(rows, x, strict=True):
        exact = sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True))
        assert found[i]["deviation"] == (exact if exact < 1 << 63 else None)


# ---- manifest --------------------------------------------------------------------------------


def plain_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha("".join(map(told, (r[0], r[1], r[2], n, r[4]))))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            yield (level[i ^ 1] if i ^ 1 < len(level) else ""), i & 1
            i >>= 1

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[3])))
    trees = {g: tree([leaf(r, r[3]) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    for j, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = [*way(trees[g], i), *way(top, j)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, r[3] + 1) if tampered else trees[g][0][i]
            for other, left in path:
                node = sha(other + node) if left else sha(node + other)
            root = top[-1][0]
            yield (r[0], trees[g][0][i], trees[g][-1][0], root, sha("".join(o for o, _ in path)), node, node == root)


@pytest.mark.parametrize("langs", [["en"], ["en", None, "", "ä", "z", "en", "en"]])
def test_manifest(spark, tmp_path, langs):
    rng = random.Random(len(langs))
    rows = [(i, rng.choice(["web", None]), langs[i % len(langs)], rng.choice([None, 5, 70]), rng.choice(["", None, "ü x", "t" * 3000])) for i in range(0, 1300, 5)]
    rows += [rows[3], rows[3], (10, "web", "en", 1, "other"), (None, None, None, None, None), (2**40, "s", "once", 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    docs.withColumns({"tree": F.lit(1), "place": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_merkle(spark, str(tmp_path)).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 64, 65])
def test_manifest_of_few(spark, n):
    docs = spark.createDataFrame([(i, "a") for i in range(n)], "id long, g string")
    made = merkle.manifest(docs, merkle.leaf(F.col("id")), F.col("g"), [F.col("id")], F.struct("id"))
    proved = merkle.proofs(made).withColumn("again", merkle.folded(F.col("digest"), F.col("path"))).collect()
    assert len(proved) == n and all(r["again"] == r["root"] == made.root == r["subroot"] for r in proved)
    assert (made.root is None) == (n == 0)
    if n == 1:
        assert made.root == sha("1:0") and proved[0]["path"] == []
