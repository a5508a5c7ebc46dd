"""Text operators against brute force, libraries and defined results at the edges."""

import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threatloom.llm import bpe, components, pii, quality, simhash, token_counts, toxicity, url_filter
from threatloom.llm.words import words_of, xxh64

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGES = [None, "", " \n\t ", "one", "Ünï cödé  x\n\ny", "<|endoftext|> a<|endoftext|>", "z" * 5000, "a b " * 3000, "日本 🎉", "x\u00a0 y\u3000 z"]
#: Columns named like those that operators make for themselves.
CLASHING = {name: 1 for name in ("word", "mark", "rank", "key", "block", "size", "table", "score", "label", "found", "id", "value")}


def frame(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    kinds = "".join(f", {name} int" for name in more)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_hashes():
    texts = pa.array(EDGES)
    found = words_of(texts)
    for i, text in enumerate(EDGES):
        span = range(found.first[i], found.first[i + 1])
        got = [found.data[found.start[k] : found.start[k] + found.size[k]].tobytes() for k in span]
        assert got == (text or "").encode().lower().split()
    data = np.frombuffer(bytes(range(256)) * 4, np.uint8)
    sizes = np.arange(0, 700, 7)
    got = xxh64(data, np.arange(len(sizes)), sizes)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(data[k : k + n].tobytes(), seed=42) for k, n in enumerate(sizes)]


def test_bpe_is_exact_and_decodes():
    library, own = Tokenizer.from_file(PATH), bpe.encoder(PATH)
    random.seed(3)
    texts = [t for t in EDGES if t] + ["".join(random.choice("abcdeéß tnh'1_ \n日") for _ in range(80)) for _ in range(400)]
    for text in texts:
        packed = own.encode_packed(text)
        ids = list(struct.unpack(f"<{len(packed) // 4}i", packed))
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert own.decode_flat(np.array(ids))[0].tobytes().decode() == text


def test_bpe_columns(spark):
    docs = frame(spark, EDGES, **CLASHING).withColumn("ids", bpe.encode(F.col("text"), PATH))
    for row in docs.withColumn("back", bpe.decode(F.col("ids"), PATH)).collect():
        assert row["back"] == (row["text"] or "")
    assert docs.limit(0).collect() == []
    both = bpe.round_trip(docs.withColumn("coded", F.lit(1)), PATH, ["doc_id", "coded", "score"])
    for row, ids in zip(sorted(both.collect()), [r["ids"] for r in docs.orderBy("doc_id").collect()], strict=True):
        assert row["coded_"].ids == ids and row["coded_"].n_tokens == len(ids) and row["coded_"].decoded == (EDGES[row["doc_id"]] or "")
    assert bpe.round_trip(docs.limit(0), PATH, []).columns == ["coded"]
    broken = spark.createDataFrame([([233, 72],), (None,), ([],)], "ids array<int>").select(bpe.decode(F.col("ids"), PATH)).collect()
    assert broken[1][0] is None and broken[2][0] == ""


def test_token_counts(spark):
    library = Tokenizer.from_file(PATH)
    texts = EDGES + ["I 'll go  now\u2003 on", "a " * 2000]
    found = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts, **CLASHING), PATH).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 1024)
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_slice(pa.array(["a b", None]), piece).tolist()[1] == 0
    assert token_counts.token_counts(frame(spark, []), PATH).count() == 0


def test_quality_counts(spark):
    random.seed(5)
    texts = EDGES + [" ".join(random.choice("abc|#") for _ in range(40)) + "\nx\nx\n \n" for _ in range(30)]
    for row in quality.base_counts(frame(spark, texts, **CLASHING)).collect():
        text, w = row["text"] or "", words(row["text"])
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert want == tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert row["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_model(spark):
    random.seed(6)
    good = [" ".join(random.choice(["then", "other", "with", "stone"]) + random.choice(["", "ed", "s"]) for _ in range(30)) for _ in range(60)]
    bad = [" ".join(random.choice(["zq", "xk"]) + random.choice("#*%") * 3 for _ in range(30)) for _ in range(60)]
    docs = frame(spark, good + bad + EDGES, **CLASHING)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, model).collect()}
    assert sum(kept[i] for i in range(60)) >= 57 and not any(kept[i] for i in range(60, 120))
    taken = docs.withColumns({"kept": F.lit(7), "score": F.lit("s"), "n_words": F.lit(None).cast("int"), "own": F.lit(1)})
    left = quality.accepted(taken, model).collect()
    assert {r["doc_id"] for r in left} == {i for i, k in kept.items() if k} and {(r["kept"], r["score"], r["n_words"]) for r in left} == {(7, "s", None)}
    nothing = quality.fit(docs, labels.limit(0))
    assert {r["doc_id"] for r in quality.judge(docs, nothing).filter("NOT kept AND NOT base_failed").collect()} == set()
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def simhash_of(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    random.seed(7)
    base = [[random.choice("abcdefghijklmnop") * 3 for _ in range(120)] for _ in range(12)]
    texts = list(EDGES)
    for w in base:
        for _ in range(8):
            v = list(w)
            v[random.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["The SAME text here now"] * 40 + ["the same text here now"]
    docs = frame(spark, texts, **CLASHING)
    prints = [simhash_of(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    found = {r["doc_id"]: (r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (prints[i], top(i)) for i in range(len(texts))}
    twice = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = sorted(r["doc_id"] for r in simhash.one_of_each_group(twice).collect())
    assert kept == sorted({top(i) for i in range(len(texts))})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pairs_with_any_thresholds(spark):
    random.seed(8)
    seeds = [random.getrandbits(64) for _ in range(30)]
    values = {s ^ sum(1 << b for b in random.sample(range(64), random.randrange(7))) for s in seeds for _ in range(12)} | {0, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "v long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert {tuple(r) for r in simhash.close_pairs(nodes, "v").collect()} == want
    for rows in (1, 10**4, 10**6, 10**9):  # whatever the plan, thresholds are enough
        parts, limits = simhash.plan_parts(rows, np.full((64, 64), rows / 4) + np.eye(64) * rows / 4)
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(limits) == 4 - len(parts) + 1


def test_components(spark):
    random.seed(9)
    links = [(i, i + 1) for i in range(60)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)]
    nodes = spark.createDataFrame([(i,) for i in range(200)], "n long")
    found = {r[0]: r[1] for r in components.components(nodes, spark.createDataFrame(links, "a long, b long"), "n").collect()}
    label = {i: i for i in range(200)}
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label


def brute_pii(text):
    out = [(*m.span(), 0) for m in pii.EMAIL.finditer(text)]
    out += [(*m.span(), 1) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for k, pattern, low, high in ((2, pii.CARD, 12, 19), (3, pii.PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (k == 3 or pii.luhn(digits)):
                out.append((*m.span(), k))
    return sorted(out)


PRIVATE = "Mail é.x@a-b.example.com, 10.0.0.256 10.0.0.25, 4111 1111-1111 1111 or 4111111111111112; +1 (555) 010-9999 token = \"" + "ab12" * 10 + '"'


#: Without the comma the digits before the card belong to its match, which then fails the check digit: no retries.
GLUED = PRIVATE.replace("25, 4111", "25 4111")


def test_pii(spark):
    random.seed(10)
    noise = ["".join(random.choice("a1.@+- ()4\n") for _ in range(60)) for _ in range(300)]
    for text in [*filter(None, EDGES), *noise, PRIVATE, GLUED]:
        assert pii.base_spans(text) == brute_pii(text)
    assert not [s for s in pii.base_spans(GLUED) if s[2] == 2]
    docs = frame(spark, [*EDGES, PRIVATE] + [f'key token = "{random.getrandbits(160):040x}" end {i}' for i in range(30)], **CLASHING)
    model = pii.fit(docs)
    rows = docs.select("doc_id", pii.find(F.col("text"), model).alias("f"), pii.mask(F.col("text"), model).alias("m")).collect()
    told = {r["doc_id"]: r for r in rows}
    assert all("secret:" in told[i]["f"]["spans"] for i in range(len(EDGES) + 1, len(EDGES) + 31))
    hidden = told[len(EDGES)]
    assert hidden["f"]["n_email"] == hidden["f"]["n_ip"] == hidden["f"]["n_card"] == hidden["f"]["n_phone"] == 1
    assert "<email>" in hidden["m"] and "4111 1111" not in hidden["m"] and told[0]["m"] is None and told[1]["m"] == ""
    assert pii.fit(docs.limit(0)).weights == tuple([0.0] * pii.FEATURES)


def test_long_runs_are_candidates():
    for kind, run in (("secret", "Ab3_" * 400), ("account", "4 0-9" * 40)):
        found = pii.candidates(f"the key = {run} ends", [])
        assert [(c.text, pii.ALL_KINDS[c.kind]) for c in found] == [(run, kind)]


def test_label_model_finds_reliabilities():
    random.seed(11)
    rates, rows = [0.95, 0.9, 0.75, 0.6], Counter()
    for _ in range(4000):
        truth = random.random() < 0.4
        rows[tuple(int(truth) if random.random() < r else int(not truth) for r in rates)] += 1
    patterns = np.array(list(rows))
    _, found, prior = pii.expectation_maximisation(patterns, np.array(list(rows.values()), float))
    assert abs(prior - 0.4) < 0.08 and all(abs(f - r) < 0.08 for f, r in zip(found, rates, strict=True))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "HTTPS://News.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://org/", "http://xorg/", "http://a.com/fr/#q", "http://a.com?fr", "x://com/de/"]
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    random.seed(12)
    more = [f"http://s{random.randrange(99)}.com/{random.choice(['fr', 'de'])}/{random.choice(['fr', 'de'])}x" for _ in range(300)]
    more = [re.sub(r"/(..)/..x", r"/\1/\1x", u) for u in more]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls + more + ["http://q.net/fr/frx", "http://q.net/de/dex"])], "page_id long, url string, found int")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert [rows[i]["rule"] for i in range(10)] == [None, None, None, "example.org/es/", "example.org/en/1", "org/", None, "com/fr/", None, "com/de/"]
    assert (rows[3]["host"], rows[3]["path"], rows[8]["host"], rows[8]["path"]) == ("news.example.org", "/es/1", "a.com", "")
    assert rows[0]["verdict"] == "block" and rows[310]["verdict"] == "allow" and rows[311]["verdict"] == "block"
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_models_count_every_gram(spark):
    """More n-grams than any fixed table of 2^15 slots has."""
    random.seed(14)
    made = lambda letters: "http://" + "".join(random.choice(letters) for _ in range(40))
    rows = [(made("abcdefghijklmnopqrstuvwxyz"), True) for _ in range(700)] + [(made("mnopqrstuvwxyz0123456789é"), False) for _ in range(700)]
    grams = [{}, {}]
    for u, side in rows:
        u = "\n" * 4 + u + "\n"
        for at in range(4, len(u)):
            for k in range(5):
                g = u[at - k : at + 1]
                grams[side][g] = grams[side].get(g, 0) + 1
    assert len(grams[0]) + len(grams[1]) > 1 << 16
    after = [{}, {}]
    for side in (0, 1):
        for g, c in grams[side].items():
            n, t = after[side].get((len(g), g[:-1]), (0, 0))
            after[side][len(g), g[:-1]] = n + c, t + 1

    def mean(u):
        u, total = "\n" * 4 + (u or "") + "\n", 0.0
        for at in range(4, len(u)):
            for side in (0, 1):
                p = 1 / 256
                for k in range(5):
                    g = u[at - k : at + 1]
                    n, t = after[side].get((len(g), g[:-1]), (0, 0))
                    p = (grams[side].get(g, 0) + t * p) / (n + t) if n else p
                total += (2 * side - 1) * np.log(p)
        return total / (len(u) - 4)

    counts = url_filter._counts(spark.createDataFrame(rows, "url string, accepted boolean"))
    asked = [u for u, _ in rows[::20]] + [made("abcxyz019é") for _ in range(50)] + [None, "", "日本"] + ["same"] * 300
    pages = spark.createDataFrame([(i, u, 0, 0) for i, u in enumerate(asked)], "page_id long, url string, salt int, mean int")
    found = {r["page_id"]: r for r in url_filter.with_score(pages, counts, "url").collect()}
    assert len(found) == len(asked) and all(abs(found[i]["score"] - mean(u)) < 1e-8 and found[i]["url"] == u for i, u in enumerate(asked))


def test_toxicity(spark):
    random.seed(13)
    clean = ["stone river", "quiet lamp", "green field", "wide road"]
    texts = [" ".join(random.choice(clean) for _ in range(20)) + (" you vile wretch" if i % 3 == 0 else "") for i in range(240)]
    docs = frame(spark, texts + EDGES, **CLASHING)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r[0]: r[1] for r in docs.select("doc_id", toxicity.score(F.col("text"), model)).collect()}
    assert all((found[i] >= 0.5) == (i % 3 == 0) for i in range(240)) and all(0 <= v <= 1 for v in found.values())
    alone = toxicity.fit(docs, labels.limit(0))
    assert docs.select(toxicity.score(F.col("text"), alone).alias("s")).filter("s <> 0.5").count() == 0


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_toxicity_features_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(toxicity, "_BLOCK", block)
    texts = [None, "Ab  cd\nef", "", "x", "abc", "z" * 40, "Ab cd ef"]
    owner, slot = toxicity._distinct(pa.array(texts))
    got = {i: set(slot[owner == i]) for i in range(len(texts))}
    for i, text in enumerate(texts):
        data = b"".join(w.encode().lower() + b" " for w in words(text))
        want = set()
        for size in toxicity.SIZES:
            for k in range(len(data) - size + 1):
                code = int.from_bytes(data[k : k + size], "big") + (size << 48)
                want.add((code * 0x9E3779B97F4A7C15 % (1 << 64)) >> 44)
        assert got[i] == want


def test_memory_of_pieces_is_bounded():
    met = bpe.Recent(1000)
    for k in range(100):
        met.put(k, k, 100)
        assert len(met) <= 5 and len(met.old) <= 5
    assert met.get(99) == 99 and met.old.get(94) == 94


def test_personal_data_with_endless_octets():
    assert pii.base_spans("1.2.3." + "0" * 9000 + "7") == [(0, 9007, 1)]
    assert pii.base_spans("1.2.3." + "0" * 9000) == [(0, 9006, 1)]
    assert pii.base_spans("1.2.3." + "9" * 9000) == [] and pii.base_spans("0256.1.1.1 255.1.1.0256") == []
