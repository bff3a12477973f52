"""Top-k search, sharding, mixing, token counts, quality and fingerprints against brute force."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtriage.llm import fingerprint, mixing, quality, shard, token_counts, topk

PATH = P.path("byte_bpe_50k.tiktoken")
VECTORS = "vec_id long, embedding array<float>, v string, len long"


def brute_top(rows, k):
    vec = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vec.setdefault(i, []).append([math.floor(64 * x) for x in e])
    out = []
    for i in vec:
        if i % 20 == 0:
            for q in vec[i]:
                s = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j in vec if j != i
                           for c in vec[j] if len(c) == len(q))[:k]
                out += [(i, r + 1, j, -p) for r, (p, j) in enumerate(s)]
    return sorted(out)


def run_top(df, k):
    got = topk.top_k(df.select("vec_id", topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 20 == 0, k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(700, 24)) * np.exp(rng.normal(size=(700, 1)))).astype(np.float32)
    x[50:250] = x[40]  # a large group of one vector
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 24), (1060, [float("inf")] * 24), (None, [0.5] * 24),
             (2000, [0.5, 0.25]), (2001, [-0.5, 0.01]), (2002, []), (2020, [])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], VECTORS)
    want = brute_top(rows, 20)
    assert run_top(df, 20) == want
    for name, value in (("BLOCK", 64), ("QUERIES", 8), ("SEEDS", 30), ("CHUNK", 16), ("HEAD", 4)):
        monkeypatch.setattr(topk, name, value)
    assert run_top(df, 20) == want
    assert run_top(df, 3) == brute_top(rows, 3)
    assert run_top(df.where("vec_id < 5"), 20) == brute_top(rows[:5], 20)
    assert run_top(df.where("false"), 20) == []


def test_only_wanted_blocks_are_shipped(spark):
    """Two kinds of queries: those that short candidates can serve, and those that need long ones."""
    n, blocks, q_blocks = 640, 10, 4
    cand = spark.createDataFrame([(i, [i], 2.0 ** -(i // 64), i // 64) for i in range(n)], "id long, v array<long>, len double, cb int")
    spans = cand.groupBy("cb").agg(F.max("len").alias("longest"))
    asks = spark.createDataFrame([(1000 + i, [1], 1.0, 0.9 if i % 4 else 2.0 ** -5) for i in range(80)],
                                 "id long, v array<long>, len double, least double")
    wanted, given = topk.block_pairs(cand, asks, spans, q_blocks)
    pairs = {(r.qb, r.cb) for r in wanted.select("qb", "cb").distinct().collect()}
    sent = given.groupBy("to_qb", "to_cb").count().collect()
    assert {(r.to_qb, r.to_cb) for r in sent} == pairs and {r["count"] for r in sent} == {64}
    # 60 queries want one block, 20 want six: ranges keep them apart
    assert given.count() == 64 * len(pairs) <= 0.4 * n * q_blocks
    assert wanted.count() == 60 * 1 + 20 * 6


def test_bounds_prune_without_loss():
    """Whole numbers of any size: beyond 2^53 the products are exact too."""
    rng = np.random.default_rng(0)
    c = rng.integers(-2 ** 29, 2 ** 29, (300, 6))
    turn = np.linalg.eigh(c.T.astype(float) @ c)[1][:, ::-1]
    row, ids, score = topk.search_block(np.arange(3), c[:3], np.full(3, -np.inf), np.arange(300), c, turn, 5)
    for q in range(3):
        want = sorted((-int(sum(int(a) * int(b) for a, b in zip(c[q], c[j], strict=True))), j) for j in range(300) if j != q)[:5]
        assert sorted((-int(s), int(i)) for r, i, s in zip(row, ids, score, strict=True) if r == q) == want


def test_shards(spark, odd, empty, monkeypatch):
    for n in (1, 4, 40):
        got = shard.read_shards(spark, shard.write_shards(odd, n), odd.schema).collect()
        total = odd.count()
        assert len(got) == total
        sizes = [sum(r["shard"] == k for r in got) for k in range(n)]
        assert max(sizes) - min(sizes) <= 1
        for k in range(n):
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
        assert sorted((str(r.doc_id), r.text or "", r.keep) for r in got) == sorted(
            (str(r.doc_id), r.text or "", r.keep) for r in odd.collect())
    assert shard.read_shards(spark, shard.write_shards(empty, 40), empty.schema).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    place = {}
    for seed in (1, 1, 2):
        rows = shard.read_shards(spark, shard.write_shards(many, 7, seed=seed), many.schema).collect()
        place.setdefault(seed, []).append({r.doc_id: (r["shard"], r["slot"]) for r in rows})
    assert place[1][0] == place[1][1] != place[2][0]  # a lost task makes the same rows again
    # uniform: neighbours by id end up anywhere
    first = [place[1][0][i][0] for i in range(700)]
    assert all(70 < first.count(k) < 130 for k in range(7))
    assert zlib.crc32(b"same text") == many.limit(1).select(F.crc32("text")).first()[0]


def brute_poisson(u, rate):
    k, term, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u and k < rate + 12 * rate ** 0.5 + 24 - 1:
        k += 1
        term *= rate / k
        c += term
    return k


def test_mixing(spark, odd, empty):
    rows = [(i, f"text {i % 50} " * (1 + i % 7), "hot" if i % 3 else f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"hot": 1.0, "s0": 2.0, "s1": 1.0}
    rate = {r["__source"]: r["__rate"] for r in mixing.rates(df, weights).collect()}
    assert rate["s2"] == rate["s3"] == 0
    got = mixing.mix(df, weights).collect()
    n = {}
    for r in got:
        n[r.doc_id] = max(n.get(r.doc_id, 0), r["copy"])
    assert len(got) == sum(n.values())
    for i, _, s in rows:
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        assert n.get(i, 0) == (brute_poisson(u, rate[s]) if rate[s] else 0)
    size = {s: sum(len(r.text) for r in got if r.source == s) for s in ("hot", "s0", "s1")}
    assert abs(size["s0"] / sum(size.values()) - 0.5) < 0.05
    assert [r.place for r in got] == sorted(r.place for r in got)
    out = mixing.mix(odd, {"s1": 1.0, None: 1.0})
    assert set(odd.columns) <= set(out.columns) and {r.source for r in out.collect()} <= {"s1", None}
    assert mixing.mix(empty).count() == 0
    # a rate far beyond what exp(-rate) can hold
    big = spark.createDataFrame([(0.5, 2000.0), (0.0, 3.0), (0.999999, 3.0)], "u double, r double")
    ks = [r[0] for r in big.select(mixing.poisson_quantile(F.col("u"), F.col("r"))).collect()]
    assert abs(ks[0] - 2000) <= 2 and ks[1] == 0 and ks[2] == brute_poisson(0.999999, 3.0)


def greedy(word, pieces, longest):
    n, i = 0, 0
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i:i + k] in pieces), 0)
        if not k:
            return 1
        n, i = n + 1, i + k
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="ab ", min_size=1, max_size=5), max_size=12), st.lists(st.text(alphabet="abc", min_size=1, max_size=14), max_size=8))
def test_longest_match_counts(pieces, words):
    pieces = {p.encode() for p in pieces}
    auto = token_counts.Automaton(sorted(pieces))
    assert auto.text(" ".join(words)) == (len(words), sum(greedy(b" " + w.encode(), pieces, 5) for w in words))


def test_token_counts(odd, empty):
    with open(PATH, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f}
    longest = max(map(len, pieces))
    want = sorted((str(r.doc_id), sum(greedy(b" " + w.encode(), pieces, longest) for w in (r.text or "").split()))
                  for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(odd, PATH).collect()) == want
    assert token_counts.token_counts(empty, PATH).count() == 0


def test_quality_held_out(spark, odd, empty):
    rnd = random.Random(1)
    fine, bad = [f"plain{i}" for i in range(400)], ["nastyish", "nastyest", "nasty"]

    def text(grade):
        words = [rnd.choice(fine) for _ in range(rnd.randint(30, 200))]
        for i in range(0, len(words), 15):
            words[i] = rnd.choice(bad) if grade == 0 else words[i]
        return " ".join(w + "###" if grade == 1 else w for w in words)

    docs = [(i, text(g := rnd.choice([0, 1, 2, 2, 2])), g) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, grade int")
    extra = spark.createDataFrame([(None, 1), (5, None), (99999, 2)], "doc_id long, grade int")
    model = quality.train(df.select("doc_id", "text"), df.where("doc_id < 1000").select("doc_id", "grade").union(extra))
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.classify(df.drop("grade"), model).join(df.select("doc_id", "grade"), "doc_id").where("doc_id >= 1000").collect()
    assert np.mean([r.keep == (r.grade == 2) for r in rows]) > 0.98
    assert np.mean([abs(r.expected_grade - r.grade) for r in rows]) < 0.2
    got = quality.classify(odd, model)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    assert quality.classify(empty, model).count() == 0
    none = quality.train(empty, empty.select("doc_id", F.lit(1).alias("grade")))
    assert all(r.keep for r in quality.classify(odd, none).collect())


def test_ordinal_gradient_finds_planted_thresholds():
    rng = np.random.default_rng(3)
    has = rng.random((6000, 3)) < 0.5
    s = has @ np.array([2.0, -2.0, 0.0]) + rng.logistic(size=6000)
    grades = (s > -1).astype(int) + (s > 1.5)
    model = quality.fit_ordinal([np.flatnonzero(r) for r in has], grades, 3, l2=1e-6, steps=400)
    assert np.allclose(model.thresholds, [-1, 1.5], atol=0.2)
    assert np.allclose(model.weights, [2, -2], atol=0.25)  # the indifferent one is screened out


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@given(st.text(alphabet="abcd", max_size=64), st.text(alphabet="abcd", max_size=64))
def test_edit_distance(a, b):
    assert fingerprint.edit_distance(a, b) == levenshtein(a, b)


def brute_signature(data, size, most):
    """Chunk ends by the rolling hash, one byte at a time."""
    ends = [i + 1 for i in range(len(data))
            if int(fingerprint.rolling(data[max(0, i - 6):i + 1])[-1]) % size == size - 1][:most - 1]
    return len(ends) + (not ends or ends[-1] < len(data))


def test_fingerprint_parts():
    rnd = random.Random(2)
    for n in (1, 6, 7, 50, 700, 5000):
        text = "".join(rnd.choice("abcdefgh ") for _ in range(n))
        size, one, two = fingerprint.fingerprint(text).split(":")
        data = np.frombuffer(text.encode(), np.uint8)
        assert len(one) == brute_signature(data, int(size), 64) and len(two) == brute_signature(data, 2 * int(size), 32)
    assert fingerprint.fingerprint("") == "3::" and fingerprint.likeness("3::", "3::") == 1
    text = " ".join(str(rnd.random()) for _ in range(300))
    other = " ".join(str(rnd.random()) for _ in range(300))
    a = fingerprint.fingerprint(text)
    assert fingerprint.likeness(a, fingerprint.fingerprint(text[:2000] + "changed" + text[2000:])) > 0.85
    assert fingerprint.likeness(a, fingerprint.fingerprint(other)) < 0.3


@pytest.mark.parametrize("least_parts", [96, 3])
def test_fingerprints(spark, odd, empty, least_parts, monkeypatch):
    plain = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda *a, **k: plain(*a, least_parts=least_parts, **k))

    def check(df):
        got = fingerprint.fingerprints(df).collect()
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        ids = [i for i, _ in rows]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got)
        if len(set(ids)) < len(ids):
            return
        order = sorted(rows, key=lambda r: -r[0])
        by = {r.doc_id: r for r in got}
        for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
            m = len(t) // 3
            new = t[:len(t) - m] + nxt[:m]
            r = by[i]
            prints = [fingerprint.fingerprint(x) for x in (t, new, nxt)]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (
                len(t), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1])
            assert r.near_edited == fingerprint.likeness(prints[0], prints[1])
            assert r.near_next == fingerprint.likeness(prints[0], prints[2])

    check(odd)
    check(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    check(odd.where("doc_id = 11"))
    check(spark.createDataFrame([(i * 7919 % 1009, "x" * (i % 13) + f"é{i}") for i in range(500)], "doc_id long, text string"))
    assert fingerprint.fingerprints(empty).count() == 0
