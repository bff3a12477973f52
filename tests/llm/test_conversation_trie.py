"""The conversation trie against a brute-force reading of its definition."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tagtriage.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, words string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tid, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * words(p)
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
                   for p, m in nodes.items()), key=lambda r: r[:2])


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA).repartition(5)
    out = T.prefix_trie(df)
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=lambda r: r[:2])
    assert got == brute(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    say = ["hello there", "", None, "how  are\tyou", "fine\x0bthanks", "a b c d"]
    out = []
    for c in list(range(150)) + [-7, -41, 10 ** 12]:
        for t in range(rnd.choice([1, 1, 2, 3, 5])):
            out.append((c, rnd.choice([t, t, t, None, 1]), rnd.choice(["user", "model", None]), rnd.choice(say[:2] if c % 3 else say)))
    out += [(c, t, "user", f"same turn {t}") for c in range(200, 260) for t in range(3)]       # identical conversations
    out += [(c, t, "user", f"same turn {t}") for c in range(260, 270) for t in range(4 + c % 3)]  # and longer ones
    out += [(300, t, "user", "again") for t in range(400)] + [(300, 5, "user", "again")]        # a long one, with a repeated row
    return out + [(None, 1, "user", "no conversation"), (None, None, None, None)]


def test_hot_keys_span_ranges_and_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 7)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert check(spark, rows).columns == [*COLUMNS, "words"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)  # its base is absent: nothing is left
    check(spark, [(lone, 1, "user", "lost"), (40, 1, None, None)])
    check(spark, [(None, 1, "user", "x")])
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_turns_of_nodes(spark, rows):
    df = spark.createDataFrame([r for r in rows], "conv_id long, turn long, role string, text string")
    nodes = T.prefix_trie(df)
    turns = T.node_turns(nodes, df)
    assert turns.count() == nodes.count()
    assert turns.where("depth > 0").select(F.count_distinct("conv_id", "depth")).first()[0] == nodes.where("depth > 0").count()
