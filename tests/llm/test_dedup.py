"""Line, near-duplicate and repeated-string removal against brute force."""

import collections
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tagtriage.llm import line_dedup, probminhash, suffix_dedup
from tests_llm_brute import brute_classes, brute_lines


def test_lines(odd, empty):
    got = line_dedup.drop_repeated_lines(odd)
    assert set(odd.columns) - {"n_lines"} <= set(got.columns)
    rows = sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert rows == sorted(brute_lines([(r.doc_id, r.text) for r in odd.collect()]), key=str)
    assert sum(r[3] for r in rows) == 2
    assert line_dedup.drop_repeated_lines(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9))
def test_windows(seed):
    rnd = random.Random(seed)
    length, alphabet = rnd.choice([3, 5, 9, 20]), range(97, 97 + rnd.choice([1, 2, 4]))
    base = bytes(rnd.choice(alphabet) for _ in range(60))
    segs = {base[min(a, b):max(a, b)] + bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 10)))
            for a, b in [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(rnd.randint(1, 8))]}
    segs = sorted(segs)
    counts = np.array([rnd.choice([1, 1, 2]) for _ in segs])
    seen = collections.Counter()
    for s, n in zip(segs, counts.tolist(), strict=True):
        for i in range(len(s) - length + 1):
            seen[s[i:i + length]] += n
    want = [[i for i in range(len(s) - length + 1) if seen[s[i:i + length]] > 1] for s in segs]
    assert [x.tolist() for x in suffix_dedup.repeated_windows(segs, counts, length)] == want


def test_common_prefixes():
    """Boundaries found level by level equal the prefixes compared directly."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        s = np.append(rng.integers(1, 3, 80), 0)
        order = suffix_dedup.suffix_order(s, 81)
        for depth in (1, 2, 5, 12):
            found = suffix_dedup.common_prefix_bounds(s, order, depth, 0)
            for i in range(1, len(s)):
                a, b = s[order[i - 1]:].tolist(), s[order[i]:].tolist()
                lcp = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert found[i] == (lcp < depth), (depth, i)


def brute_repeats(docs, length):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, r in raw:
        seen.update(r[k:k + length] for k in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        hit = np.zeros(len(r) + 1, int)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                hit[k] += 1
                hit[k + length] -= 1
        hit = np.cumsum(hit[:-1]) > 0 if len(r) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(r, np.uint8)[~hit])
        n = int((np.diff(np.append(0, hit.astype(int))) == 1).sum())
        out.append((i, len(r), int(hit.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _removed(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
                   for r in suffix_dedup.remove_repeats(df, length).collect()), key=str)


def test_repeats(spark, odd, empty, monkeypatch):
    small = odd.where("doc_id IS NULL OR doc_id <> 7")
    want = brute_repeats([(r.doc_id, r.text) for r in small.collect()], 400)
    assert _removed(small, 400) == want
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon"]
    shared = " ".join(rnd.choice(words) for _ in range(60))
    docs = [(i, " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(20))
             + (shared[rnd.randint(0, 40):rnd.randint(150, 300)] if i % 3 else "")
             + " ".join(rnd.choice(words) for _ in range(10))) for i in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_repeats(docs, 40)
    assert sum(r[2] for r in want) > 1000
    assert _removed(df, 40) == want
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 300)  # crowded anchors: their windows go to anchors of longer grams
    monkeypatch.setattr(suffix_dedup, "ROW_BITS", 6)  # filter of documents full
    assert _removed(df, 40) == want
    twice = docs + docs[:5]
    assert _removed(spark.createDataFrame(twice, "doc_id long, text string"), 40) == brute_repeats(twice, 40)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_crowded_anchor(spark, monkeypatch):
    """5,000 different segments of one anchor are judged by the transform, together and by finer anchors."""
    rnd = random.Random(6)
    core = "".join(rnd.choice("abcdefgh") for _ in range(393))
    docs = [(i, "".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 30))) + core
             + "".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 30)))) for i in range(5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_repeats(docs, 400)
    assert 10 < sum(r[2] > 0 for r in want) < 4990
    assert _removed(df, 400) == want
    finer, real = [], suffix_dedup._finer
    monkeypatch.setattr(suffix_dedup, "_finer", lambda *a: finer.append(a[-1]) or real(*a))
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1 << 14)
    assert _removed(df, 400) == want
    assert finer == [385, 400]


def test_long_text_and_repeats_inside(spark):
    """A text of 10 MB that repeats a passage of its own and one of a short text."""
    rng = np.random.default_rng(7)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)
    raw = letters[rng.integers(0, 27, 10_000_000)].tobytes().decode()
    raw = raw[:6_000_000] + raw[1_000_000:1_000_900] + raw[6_000_900:]
    docs = [(1, raw), (2, "short " * 3 + raw[9_000_000:9_000_450] + " end")]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    spans = [(s.start, s.end) for s in got[1].removed]
    assert spans == [(1_000_000, 1_000_900), (6_000_000, 6_000_900), (9_000_000, 9_000_450)]
    assert [(s.start, s.end) for s in got[2].removed] == [(18, 468)] and bytes(got[2].kept) == b"short " * 3 + b" end"


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    ids = np.sort(rng.integers(0, 2 ** 63, 80).astype(np.uint64))
    a, b, x, y = ids[:60], ids[15:], rng.integers(1, 6, 60).astype(float), rng.integers(1, 6, 65).astype(float)
    p, q = dict(zip(a.tolist(), x, strict=True)), dict(zip(b.tolist(), y, strict=True))
    want = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in set(p) | set(q)) for i in set(p) & set(q))
    assert abs(probminhash.probability_jaccard(a, x, b, y) - want) < 1e-12
    sig = probminhash.signatures(np.concatenate([a, b]), np.concatenate([x, y]), np.repeat([0, 1], [60, 65]), 2, 8192)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.025


def test_near_duplicates(spark, odd, empty):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    docs, k = [], 0
    for family in range(12):
        base = [rnd.choice(words) for _ in range(120)]
        for _ in range(rnd.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                text[rnd.randrange(120)] = rnd.choice(words)
            docs.append((k, " ".join(text)))
            k += 1
    docs += [(k, "one two"), (k + 1, "one two"), (k + 2, "one two three"), (k + 3, None), (k + 4, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = probminhash.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)
    assert sorted(r.doc_id for r in rows if r.keep) == sorted(set(brute_classes(docs).values()))
    odd_rows = probminhash.near_duplicates(odd).collect()
    assert len(odd_rows) == odd.count()
    got = {r.doc_id: r.class_id for r in odd_rows if r.doc_id is not None}
    assert got[9] == got[10] == 8 and got[4] == 4 and got[5] == 5 and got[6] == 6
    kept = probminhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        map(str, [1, 2, 3, 4, 5, 6, 7, 8, 11, 12, None, None]))
    assert probminhash.near_duplicates(empty).count() == 0
    assert probminhash.keep_one(empty).count() == 0


def test_chain_of_links_is_one_class(spark):
    """Neighbours are near, ends are not: still one component."""
    base = [f"t{i}" for i in range(200)]
    docs = []
    for k in range(12):
        docs.append((k, " ".join(base)))
        for j in (3, 6, 9):
            base[(k * 17 + j * 11) % 200] = f"new{k}-{j}"
    rows = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(docs)


def test_open_pairs_in_blocks(spark, monkeypatch):
    """One text edited heavily: most copies are too far from the hub, some near each other; the
    blocks find every link that brute force finds."""
    monkeypatch.setattr(probminhash, "BLOCK", 7)
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(150)]
    docs = []
    for k in range(60):
        text = list(base)
        for i in rnd.sample(range(150), rnd.choice([0, 2, 5, 7, 9])):
            text[i] = f"x{k if k % 4 else k - 1}-{i}"  # neighbours share some edits
        docs.append((k, " ".join(text)))
    rows = probminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_classes(docs)
    assert len(set(want.values())) > 5
    assert {r.doc_id: r.class_id for r in rows} == want
