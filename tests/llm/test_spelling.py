"""Spelling variants against brute force; the affected-gram bound by trying every edit."""

import collections
import itertools
import random
import re
import string
import zlib

import pytest

from tagtriage.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs):
    table = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    count = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(table)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def brute_variants(n):
    by = collections.defaultdict(list)
    for a, b in itertools.combinations(sorted(n), 2):
        if near(a, b):
            by[a].append(b)
            by[b].append(a)
    form = {}
    for w in n:
        best = min(by[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def collect(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.fixture(scope="module")
def counted():
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("aeiourstnl") for _ in range(rnd.randint(6, 14))) for _ in range(60)]
    words = {}
    for s in stems:
        words[s] = rnd.choice([5, 40, 300, 3000])
        for _ in range(6):
            i = rnd.randint(0, len(s))
            v = rnd.choice([s[:i] + rnd.choice("xyéß") + s[i:], s[:i] + s[i + 1:], s[:i] + rnd.choice("aez") + s[i + 1:]])
            if len(v) >= 6:
                words[v] = rnd.choice([5, 7, 40, 40, 300])
    # a third of the words share a long end, another lot all but the first letters; and one very long word
    words |= {f"{a}{b}{c}ationally": 5 + i for i, (a, b, c) in enumerate(itertools.product("abcdef", "aeiou", "xyz"))}
    words |= {f"{'z' * 10}{a}{b}": 9 for a in "abcdefgh" for b in "aeiou"}
    words |= {"ab" * 400: 7, "ab" * 400 + "a": 50, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 700}
    return words


@pytest.mark.parametrize(("common", "long_list"), [(100, 400), (3, 2)])
def test_against_brute_force(spark, counted, common, long_list):
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert collect(S.variants(df, common=common, long_list=long_list)) == brute_variants(counted)


def test_documents(spark, odd):
    rnd = random.Random(9)
    vocab = ["Straße", "étrange", "bonjour", "morning", "Morning", "evenings", "ÀÉÎÕÜÿ", "short", "a" * 40]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(120)) + "—punct;12" + rnd.choice(vocab)) for i in range(60)]
    docs += [(None, "morning " * 9), (3, None), (4, ""), (3, "evenings,évenings " * 300), (3, "evenings,évenings " * 300)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    n = brute_words(docs)
    assert {r.word: r.n for r in S.words_of(df).collect()} == n
    assert collect(S.spelling_variants(df)) == brute_variants(n)
    plain = [(r.doc_id, r.text) for r in odd.collect()]
    assert collect(S.spelling_variants(odd)) == brute_variants(brute_words(plain))


def test_empty(spark, empty):
    assert S.spelling_variants(empty).collect() == []


def test_every_edit_leaves_a_listed_gram():
    """For random common grams and all single edits, two near words meet in a list of both."""
    rnd = random.Random(1)
    for _ in range(300):
        letters = rnd.choice(["ab", "abc", "abcdefgh"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 13)))
        edits = {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters} | {a[:i] + c + a[i + 1:] for i in range(len(a)) for c in letters}
        common = {}  # closed under taking beginnings, as frequencies are

        def frequency(g):
            if g not in common:
                common[g] = (len(g) == S.SHORT or frequency(g[:-1]) > 0) and rnd.random() < 0.7 and rnd.randint(1, 9)
            return common[g]

        def listed(w, family):
            hot = {(p, q): frequency(w[p - 1:p - 1 + q]) for p in range(1, len(w) + 1) for q in range(S.SHORT, S.LONG + 1)
                   if p - 1 + q <= len(w) and frequency(w[p - 1:p - 1 + q])}
            return [(p + s, w[p - 1:p - 1 + q]) for p, q in S.lists(w, hot, family) for s in ((0,) if len(w) == family else (0, 1))]

        for b in edits - {a}:
            family = max(len(a), len(b))
            assert set(listed(a, family)) & set(listed(b, family)), (a, b)
