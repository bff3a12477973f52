"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those
that end there; a sequence that is a proper prefix of another is dropped by an
anti-join, which leaves the leaves; weighted prefixes of the sequences are then
added up to nodes.

A prefix is named by 128 bits: the exclusive or of the hashes of (depth, turn)
up to its depth, so that it can be added up piece by piece. Nothing here holds
a whole conversation, a whole subtree or all members of a node in one place:
turns are numbered and added up over sorted ranges (``running``), and a
subtree's sum is taken from suffix sums of the sequences that pass through.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtriage.llm.common import store

HEAD, BLOCK = 4, 20
WORD = r"[^\x20\x09-\x0D]+"
CHUNK = 4096
_KEY = ["k1", "k2", "depth"]


def running(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, tuple], name: str) -> DataFrame:
    """``df`` with running totals by ``key`` along ``order``, whatever a key's size.

    ``sums`` maps a new column to (aggregate function, input column, how two
    totals combine); the function also adds up totals, so a count is a sum of ones. Rows are dealt into sorted ranges of (key, order) and
    stored with their range's number; each range adds up its own rows, and a key
    that spans ranges gets what the ranges before hold of it. That table has at
    most two rows a range, so it is broadcast."""
    parts = store(df.repartitionByRange(*key, *order).withColumn("__part", F.spark_partition_id()), name)
    w = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = (parts.groupBy(*key, "__part").agg(*[f(c).alias(n) for n, (f, c, _) in sums.items()])
              .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("__n > 1"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__part").alias("__at"),
                          *[f(n).over(before).alias(f"__c_{n}") for n, (f, _, _) in sums.items()])
    local = parts.select("*", *[f(c).over(w).alias(n) for n, (f, c, _) in sums.items()])
    same = F.col("__part") == F.col("__at")
    for k in key:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    out = local.join(F.broadcast(carry), same, "left")
    for n, (_, _, add) in sums.items():
        c = F.col(f"__c_{n}")
        out = out.withColumn(n, F.when(c.isNull(), F.col(n)).otherwise(add(F.col(n), c)))
    return out.select(*df.columns, *sums)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tid, words): a turn is named by the md5 of role and text,
    so texts are read once and never shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.encode(F.concat(F.octet_length(role), F.lit(":"), role, text), "UTF-8"))).alias("tid"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, tid, words) of every rebuilt conversation, with a textless
    row at depth 0: the first h turns of conversation ``c - c % 20``, then c's own
    after its first h; h is crc32 of the decimal id modulo 4."""
    at = running(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("tid"), F.col("words")],
                 {"pos": (F.sum, F.lit(1), _plus)}, "turns")
    sizes = store(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size")), "conversations")
    ids = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % HEAD).alias("h"),
                       (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    heads = sizes.select(F.col("conv_id").alias("base"), F.least("size", F.lit(HEAD - 1)).alias("n_head"))
    ids = store(ids.join(heads, "base", "left").select("conv_id", "h", "base", F.coalesce("n_head", F.lit(0)).alias("n_head")), "heads")
    at = store(at.select("conv_id", "pos", "tid", "words"), "positions")
    first = at.where((F.col("pos") < HEAD) & (F.col("conv_id") % BLOCK == 0)).select(
        F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "tid", "words")
    lent = ids.where("h > 0").join(first, "base").where("depth <= h").select("conv_id", "depth", "tid", "words")
    own = at.join(ids, "conv_id").where("pos > h").select(
        "conv_id", (F.least("h", "n_head") + F.col("pos") - F.col("h")).alias("depth"), "tid", "words")
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("tid"),
                       F.lit(0).cast("long").alias("words"))
    return lent.unionByName(own).unionByName(roots)


def _ends(ends: DataFrame) -> DataFrame:
    """(key, weight, least, ends_sha256) of every distinct sequence. Ids are ranked
    within their sequence and joined in chunks of ``CHUNK``; a digest over
    several chunks streams them in order, a chunk at a time."""
    ranked = running(ends, _KEY, [F.col("conv_id")], {"rank": (F.sum, F.lit(1), _plus)}, "ends")
    chunks = store(ranked.groupBy(*_KEY, F.floor((F.col("rank") - 1) / CHUNK).alias("chunk"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
                        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")),
                   "end-lists")
    sizes = chunks.groupBy(*_KEY).agg(F.sum("n").alias("weight"), F.min("least").alias("least"))
    one = chunks.where(f"chunk = 0 AND n < {CHUNK}").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    long = chunks.join(chunks.where(f"chunk = 0 AND n = {CHUNK}").select(*_KEY), _KEY, "left_semi")

    def digest(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append([*key, sha.hexdigest()])
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], x, strict=True)) for x in out])
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*_KEY, "ends_sha256"], [*key, sha.hexdigest()], strict=True))])

    streamed = (long.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
                .mapInArrow(digest, "k1 long, k2 long, depth long, ends_sha256 string"))
    return sizes.join(one.unionByName(streamed), _KEY)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node (a distinct sequence of the first d rebuilt turns): conv_id
    (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the turn's words.

    ``conversations`` has conv_id, turn, role and text; other columns, whatever
    their names, are left aside. Null role or text is empty; a null turn comes
    first; turns of one conversation with an equal number are taken in the order
    of the md5 of role and text (equal rows are turns of their own). Rows
    without conv_id belong to no conversation. A conversation whose rebuilt form
    has no turn ends at the root. An empty table has no nodes, not even a root.

    Nodes are partial sums over the collapsed sequences, so a prefix that a third
    of all conversations share reaches the shuffle as a row a task. Saved tokens
    of a subtree are sums over the sequences through its top: weight times the
    words from there on, less the words of the nodes that the sequence is the
    first to hold (those of which it is the smallest member)."""
    bits = [F.when(F.col("tid").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), "depth", "tid")).alias(f"t{seed}") for seed in (1, 2)]
    steps = rebuilt(turns_of(conversations)).select("conv_id", "depth", "words", *bits)
    path = store(running(steps, ["conv_id"], [F.col("depth")],
                         {"k1": (F.bit_xor, "t1", _xor), "k2": (F.bit_xor, "t2", _xor), "upto": (F.sum, "words", _plus)}, "steps"), "paths")

    # whole sequences: their last prefix names them
    last = path.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "upto")).alias("e"))
    last = store(last.select("conv_id", "e.*"), "sequences")
    ends = store(_ends(last.select("conv_id", *_KEY)), "weighted")
    seqs = ends.select("weight", F.col("least").alias("conv_id"), F.col("depth").alias("length")) \
        .join(last.select("conv_id", F.col("upto").alias("total")), "conv_id")
    steps = store(path.join(seqs, "conv_id"), "weighted-prefixes")

    # nodes, and the sequences that are no proper prefix
    nodes = store(steps.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("words").alias("words"),
        F.min(F.col("k1").bitwiseXOR(F.col("t1"))).alias("p1"), F.min(F.col("k2").bitwiseXOR(F.col("t2"))).alias("p2")), "nodes")
    proper = steps.where("depth < length").select(*_KEY).distinct()
    leaves = ends.join(proper, _KEY, "left_anti").select(F.col("least").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.sum("words").alias("owned"))
    facts = store(seqs.select("conv_id").join(leaves, "conv_id", "left").join(owned, "conv_id", "left"), "sequence-facts")
    rest = F.col("total") - F.col("upto") + F.col("words")
    first = F.coalesce(F.when(F.col("depth") >= F.col("owns_from"), rest).otherwise(F.col("owned")), F.lit(0))
    below = (steps.join(facts, "conv_id").groupBy(*_KEY)
             .agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
                  F.sum(F.col("weight") * rest - first).alias("saved_tokens")))

    children = (nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count(F.lit(1)).alias("n_children")))
    tops = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"),
                        F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (nodes.join(below, _KEY).join(children, _KEY, "left").join(ends.select(*_KEY, "ends_sha256"), _KEY, "left")
            .join(store(tops, "tops"), ["p1", "p2", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "words"))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turn that each node adds: (conv_id, depth, tid) by its smallest member.
    ``tid`` is the md5 of role and text (see ``turns_of``)."""
    return nodes.select("conv_id", "depth").join(rebuilt(turns_of(conversations)).drop("words"), ["conv_id", "depth"])
