"""Near duplicates by ProbMinHash.

A document is a set of word shingles weighted by how often they occur. Every
shingle is a Poisson process with its weight as the rate; each arrival falls
into one of the signature's registers, and a register keeps the shingle that
arrives first. Two documents agree in a register with the probability Jaccard
similarity of their weights. A shingle stops sending arrivals once they come
later than all registers of its document. Bands of registers make candidates,
which are verified by the exact similarity; classes are the connected
components of the verified links.

A bucket is first compared with its hub, the node that shares most buckets
with others: of a group of edited copies, mostly the text they come from. Only
pairs that are in different components after that are compared one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, row_key, row_spans, store, utf8_buffer

WORDS, LEAST = 5, 0.8
# 32 bands of 5 registers: a pair at similarity 0.8 misses all bands with probability 3e-6
BANDS, ROWS = 32, 5
# Pairs of a bucket that its hub leaves open are compared by sketches of 512 registers of 8 bits, in
# blocks of so many nodes. A pair at 0.8 agrees in 0.72 of them but for a probability of 3e-6.
SKETCH, SLACK, BLOCK = 512, 0.08, 1024
CACHE = 150_000

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str], cache: dict[str, int]) -> np.ndarray:
    got = [cache.get(w) for w in words]
    for i, (w, h) in enumerate(zip(words, got, strict=True)):
        if h is None:
            if len(cache) > CACHE:
                cache.clear()
            cache[w] = got[i] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(got, np.uint64)


def shingles(text: str | None, cache: dict[str, int], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, their weights): runs of n lower-cased words; a
    shorter text is one shingle; a text without words has none. A shingle that
    occurs c times weighs 1 + ln(c): with c itself, a line repeated hundreds of
    times would make documents alike that share nothing else."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = word_hashes(words, cache)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h * GOLD + w[j:len(w) - k + 1 + j])
    ids, counts = np.unique(h, return_counts=True)
    return ids, 1.0 + np.log(counts)


def signatures(ids: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int,
               m: int = BANDS * ROWS) -> np.ndarray:
    """Winning shingle of each register, a row for each document that has
    shingles. All documents' arrivals go on side by side."""
    first = np.full(n_docs * m, np.inf)
    won = np.zeros(n_docs * m, np.uint64)
    t = np.zeros(len(ids))
    for k in range(1, 1 << 30):
        x = mix(ids + np.uint64(k * int(GOLD) % 2 ** 64))
        t = t - np.log(((x >> np.uint64(12)).astype(float) + 0.5) * 2.0 ** -52) / weights
        reg = doc * m + (mix(x ^ GOLD) % np.uint64(m)).astype(np.int64)
        early = np.flatnonzero(t < first[reg])
        np.minimum.at(first, reg[early], t[early])
        best = early[t[early] == first[reg[early]]]
        won[reg[best]] = ids[best]
        last = first.reshape(n_docs, m).max(axis=1)
        live = t < last[doc]
        if not live.any():
            break
        if not live.all():
            ids, weights, doc, t = ids[live], weights[live], doc[live], t[live]
    return won.reshape(n_docs, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over shared shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i). Shingles
    of equal weights in both are taken together."""
    both, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    shared, n = np.unique(np.stack([x[at], y[bt]], 1), axis=0, return_counts=True)
    only_x = float(x.sum() - x[at].sum())
    only_y = float(y.sum() - y[bt].sum())
    u, v = shared[:, 0], shared[:, 1]
    total = (np.maximum(u[None, :] / u[:, None], v[None, :] / v[:, None]) * n[None, :]).sum(1) + only_x / u + only_y / v
    return float((n / total).sum())


SPAN_BYTES = 1 << 20


def _sketch(rows: DataFrame) -> DataFrame:
    """(__row, node, bands) of each document with words: node is a 64-bit hash of
    its weighted shingles, bands the hashes of the signature's bands."""
    def work(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            _, off = utf8_buffer(batch.column(1))
            for a, b in row_spans(off, SPAN_BYTES):
                got = [shingles(t, cache) for t in batch.column(1).slice(a, b - a).to_pylist()]
                have = [i for i, g in enumerate(got) if len(g[0])]
                if not have:
                    continue
                got = [got[i] for i in have]
                sizes = [len(g[0]) for g in got]
                sig = signatures(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]),
                                 np.repeat(np.arange(len(got)), sizes), len(got))
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(got), BANDS)).copy()
                for r in range(ROWS):
                    band = mix(band * GOLD + sig[:, r::ROWS])
                node = [xxhash.xxh3_64_intdigest(g[0].tobytes() + g[1].tobytes()) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(have)),
                     pa.array(np.array(node, np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(np.arange(0, band.size + 1, BANDS, dtype=np.int32),
                                              band.reshape(-1).view(np.int64))],
                    ["__row", "node", "bands"])

    return rows.select("__row", "__text").mapInArrow(work, "__row long, node long, bands array<long>")


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes at similarity ``least`` or more."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def work(batches):
        cache, kept = {}, (None, None)
        for batch in batches:
            ok = []
            for ta, b, tb in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(),
                                 batch.column(3).to_pylist(), strict=True):
                if kept[0] != b:  # rows of one b mostly follow each other
                    kept = (b, shingles(tb, cache))
                ok.append(probability_jaccard(*shingles(ta, cache), *kept[1]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(work, "a long, b long")


def _ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _open_pairs(placed: DataFrame, texts: DataFrame, bands: DataFrame, least: float) -> DataFrame:
    """(a, b) of nodes that share a bucket, lie in different components, and may
    reach ``least`` by their sketches. placed: (key, node, root, n); bands: (node,
    bands). A bucket of n nodes is cut into blocks by a hash of the node; each
    pair of blocks is one task's group. Of the buckets that a pair shares, the
    one of its first common band makes the pair: it holds both nodes, in
    different components, so it is open too."""
    def sketch(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [shingles(t, cache) for t in batch.column(1).to_pylist()]
            sig = signatures(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]),
                             np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), len(got), SKETCH)
            short = (mix(sig) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in short], pa.binary())],
                                             ["node", "sketch"])

    nodes = placed.select("node").distinct()
    sketches = store(texts.join(nodes, "node").select("node", "text").mapInArrow(sketch, "node long, sketch binary"), "sketches")
    sketches = store(sketches.join(bands, "node"), "sketches-bands")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = (placed.withColumn("own", own).join(sketches, "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node",
                    "root", "sketch", "bands"))

    def compare(t: pa.Table) -> pa.Table:
        node, root, own = (t[c].to_numpy() for c in ("node", "root", "own"))
        sk = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(node), SKETCH)
        band = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        key, i, j = t["key"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        left, right = (np.arange(len(node)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
        # of the agreeing registers, one in 256 of the others agrees by chance
        enough = SKETCH * (least - SLACK + (1 - least + SLACK) / 256)
        a, b = [], []
        for x in left.tolist():
            y = right[(root[right] != root[x]) & (node[right] > node[x])] if i == j else right[root[right] != root[x]]
            if len(y):
                y = y[(sk[y] == sk[x]).sum(1) >= enough]
                y = y[band[x][(band[y] == band[x]).argmax(1)] == key]
                a.append(np.full(len(y), node[x]))
                b.append(node[y])
        a = np.concatenate(a) if a else np.zeros(0, np.int64)
        b = np.concatenate(b) if b else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of every connected component, for the nodes
    that have links. Each round hooks roots to the smallest neighbouring root and
    halves the paths; every round is stored in the shared folder."""
    ends = store(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct(), "ends")
    comp = store(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        # roots that some node of another root links to
        seen = (ends.join(comp.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("root").alias("near")))
        hook = (comp.join(seen, comp["node"] == seen["a"])
                .groupBy("root").agg(F.min("near").alias("near")).where("near < root"))
        hook = store(hook, "hooks")
        moved = comp.join(hook, "root", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = store(moved.join(jump, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")),
                    "roots")
        changed = hook.limit(1).count() or new.join(
            new.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").where("above <> root").limit(1).count()
        comp = new
        if not changed:
            return comp


def near_duplicates(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, class_id (the smallest id of its
    class), keep (boolean: the row that stands for its class) and __row (a hash
    of id and text).

    Classes are the connected components of links at probability Jaccard
    similarity ``least`` or more between the weighted five-word shingles. Texts
    with equal weighted shingles are one node, however many copies there are.
    Null, empty and blank texts have no shingles: each is a class of its own.
    Rows of equal id and text are all marked alike. Null ids are larger than
    any other. Other columns are ignored.

    The rows made are linear in a bucket's size: one a node against the hub,
    and one a node and block for what stays open. Open pairs are compared
    inside tasks of bounded size, by sketches; only those that may reach
    ``least`` leave them, to be verified."""
    arrow_rows(docs.sparkSession, 500)
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    base = base.withColumn("__row", row_key("doc_id", "__text"))
    sketch = store(_sketch(base), "sketch")
    # one node a body; its smallest row stands for the text
    nodes = store(sketch.groupBy("node").agg(F.min("__row").alias("__row"), F.any_value("bands").alias("bands")), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = store(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    hits = store(entries.join(shared, "key").select("key", "node", "n"), "hits")
    degrees = store(hits.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    hubs = store(hits.join(degrees, "node").groupBy("key").agg(
        F.max(F.struct("degree", (-F.col("node")).alias("m"))).alias("best")).select("key", (-F.col("best.m")).alias("hub")), "hubs")
    wanted = degrees.select("node").join(nodes.select("node", "__row"), "node")
    texts = store(base.join(wanted, "__row").select("node", F.col("__text").alias("text")).dropDuplicates(["node"]), "texts")
    pairs = _ordered(hits.join(hubs, "key").where("node <> hub"), "node", "hub")
    pairs = store(pairs.distinct(), "pairs")
    links = store(_verify(pairs, texts, least), "links")
    comp = components(links)
    # entries of buckets that still hold several components
    placed = store(hits.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    several = store(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
                    .where("lo < hi").select("key", "n"), "several")
    found = _open_pairs(placed.join(several, "key"), texts, nodes.select("node", "bands"), least)
    found = store(found.distinct().join(pairs, ["a", "b"], "left_anti"), "open-pairs")
    more = store(_verify(found, texts, least), "links")
    if more.limit(1).count():
        comp = components(links.unionByName(more))
    rooted = nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("__row"))
    rows = sketch.select("__row", "node").distinct()
    heads = (base.select("doc_id", "__row").join(rows, "__row").groupBy("node").agg(F.min(order).alias("head")))
    per_root = store(rooted.join(heads, "node"), "heads")
    best = per_root.groupBy("root").agg(F.min("head").alias("head"))
    classes = store(per_root.select("node", "root").join(best, "root").select("node", "head"), "classes")
    by_row = store(rows.join(classes, "node").select(F.col("__row").alias("r"), "head"), "rows")
    out = base.select("doc_id", "__row").join(by_row, F.col("__row") == F.col("r"), "left")
    alone = F.col("r").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
                      F.coalesce(F.col("__row") == F.col("head.__row"), F.lit(True)).alias("keep"), "__row")


def keep_one(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that stand for their class of near duplicates:
    one of each class, also of rows that are equal in id and text. Texts are
    shuffled once, to meet the kept rows."""
    marks = near_duplicates(docs, least, id_col, text_col).where("keep")
    kept = store(marks.groupBy(F.col("__row").alias("__kept")).agg(F.count("*").alias("__n")), "kept")
    rows = docs.withColumn("__row", row_key(id_col, text_col)).join(kept.select("__kept"), F.col("__row") == F.col("__kept"))
    if kept.where("__n > 1").limit(1).count():
        rows = rows.dropDuplicates(["__row"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
