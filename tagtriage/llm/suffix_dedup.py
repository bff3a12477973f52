"""Exact removal of repeated byte strings by threshold-bounded interval expansion
on a Burrows-Wheeler transform.

A byte is removed if a string of ``length`` bytes over it also starts anywhere
else. Routing: every window of ``length`` bytes has one anchor, the least of
its k-byte hashes. Equal windows have equal anchors at equal offsets, so the
windows of one anchor hash can be judged apart from all others. The bytes that
the windows of one anchor span are a segment; equal segments are one row with a
count. Judging: the segments of some anchor hashes, laid end to end, are put
into a Burrows-Wheeler transform. From the interval of the empty string,
intervals are extended backward by a character, breadth first: in round t the
boundaries between suffixes whose common prefix has t bytes are found. The
rounds stop at ``length``; suffixes without a boundary between them then share
``length`` bytes, and are the repeated windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, powers, row_key, row_spans, store, utf8_buffer

LENGTH, GRAM = 400, 96
SPAN_BYTES = 1 << 20


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, anchor, first window, last window, hash of the anchor) of every run of windows with
    one anchor, as places in ``data``; texts are data[off[i]:off[i + 1]]."""
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    sizes = np.diff(off)
    if n < length or not (sizes >= length).any():
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[1:], out=total[1:])
    h = (total[gram:] - total[:-gram]) * powers(n + 1, inverse=True)[:n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # order by 32 bits of the hash, then leftmost: the place is part of the key
    m = len(h)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    pad = -(-m // w) * w
    full = np.full(pad, np.iinfo(np.uint64).max, np.uint64)
    full[:m] = key
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    k = n - length + 1  # windows of the whole buffer
    at = np.minimum(back[:k], ahead[w - 1:w - 1 + k]) & np.uint64(0xFFFFFFFF)
    # windows inside one text
    edge = np.zeros(n + 1, np.int32)
    big = np.flatnonzero(sizes >= length)
    edge[off[big]] += 1
    edge[off[big] + sizes[big] - length + 1] -= 1
    win = np.flatnonzero(np.cumsum(edge[:k]) > 0)
    at = at[win].astype(np.int64)
    new = np.ones(len(win), bool)
    new[1:] = (at[1:] != at[:-1]) | (win[1:] != win[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(win)) - 1
    lo, hi, a = win[first], win[last], at[first]
    return np.searchsorted(off, lo, side="right") - 1, a, lo, hi, h[a]


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``s`` in the order of their suffixes' first ``depth`` symbols at
    least. Ranks of short prefixes are joined into ranks of longer ones."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    have = min(62 // bits, n)
    padded = np.zeros(n + have, np.int64)
    padded[:n] = s
    key = np.zeros(n, np.int64)
    for k in range(have):
        key = key << bits | padded[k:k + n]
    order = np.argsort(key).astype(np.int32)
    new = np.ones(n + 1, bool)
    new[1:n] = np.diff(key[order]) != 0
    del key
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n, dtype=np.int32), 0))
    ways = 3 if n < (1 << 21) - 1 else 2
    width = 21 if ways == 3 else 31
    while have < depth:
        open_ = np.flatnonzero(~(new[:n] & new[1:]))  # slots whose suffix isn't alone yet
        if not len(open_):
            break
        at = order[open_]
        key = rank[at].astype(np.int64)
        for k in range(1, ways):
            nxt = at + k * have
            key = key << width | np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        o = np.argsort(key)
        key = key[o]
        order[open_] = at[o]
        new[open_[1:]] |= np.diff(key) != 0
        rank[order[open_]] = np.maximum.accumulate(np.where(new[open_], open_, 0))
        have *= ways
    return order


def common_prefix_bounds(s: np.ndarray, order: np.ndarray, depth: int, stop: int) -> np.ndarray:
    """found[i]: the suffixes at order[i - 1] and order[i] have a common prefix of
    less than ``depth`` symbols. Symbol ``stop`` ends a string and is not
    extended over.

    Breadth-first backward extension: an interval of the suffixes that start
    with a string w becomes, for each symbol c of the transform inside it, the
    interval of cw. Its end is a boundary of common prefix |w|, unless a
    shorter one was found there; only intervals with a new end go on."""
    n = len(s)
    bwt = s[order - 1]
    by = np.argsort(bwt.astype(np.uint16), kind="stable").astype(np.int32)
    last_first = np.empty(n, np.int32)
    last_first[by] = np.arange(n, dtype=np.int32)
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    same = bwt[by[1:]] == bwt[by[:-1]]
    after[by[:-1][same]] = by[1:][same]
    before[by[1:][same]] = by[:-1][same]
    ends_string = bwt == stop
    before[ends_string], after[ends_string] = n, -1  # neither a first nor a last occurrence anywhere
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    del by, same, bwt
    # the intervals of single symbols
    count = np.bincount(s)
    hi = np.cumsum(count)[count > 0].astype(np.int32)
    lo = hi - count[count > 0].astype(np.int32)
    if depth > 0:
        fresh = ~found[hi]
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = True
    for _ in range(1, depth):
        if not len(lo):
            break
        size = hi - lo
        # an interval of one suffix has one symbol before it
        single = lo[size == 1]
        a = last_first[single[~ends_string[single]]]
        b = a + 1
        many = np.flatnonzero(size > 1)
        if len(many):
            low, high, size = lo[many], hi[many], size[many]
            at = np.arange(int(size.sum()), dtype=np.int32) + np.repeat(low - (np.cumsum(size) - size).astype(np.int32), size)
            own = np.repeat(np.arange(len(many), dtype=np.int32), size)
            # of each interval, the symbols' first and last occurrences, in the order of symbols
            ends = []
            for pick in (np.flatnonzero(before[at] < np.repeat(low, size)), np.flatnonzero(after[at] >= np.repeat(high, size))):
                key = own[pick].astype(np.int64) << 32 | last_first[at[pick]]
                key.sort()
                ends.append(key.astype(np.int32))  # the last 32 bits
            a, b = np.append(a, ends[0]), np.append(b, ends[1] + 1)
        fresh = ~found[b]
        lo, hi = a[fresh], b[fresh]
        found[hi] = True
    return found


def repeated_windows(segments: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the starts of its windows that also start elsewhere:
    in another segment, or in another copy of this one (``counts``)."""
    sizes = np.array([len(x) for x in segments], np.int64)
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    code = np.zeros(256, np.int16)
    body = np.ones(len(raw), bool)
    body[starts + sizes] = False
    used = np.unique(raw[body])
    code[used] = np.arange(1, len(used) + 1)
    s = np.where(body, code[raw], np.int16(0))
    order = suffix_order(s, length)
    found = common_prefix_bounds(s, order, length, 0)
    weight = np.zeros(len(s), np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    edge = np.zeros(len(s) + 1, np.int64)
    np.add.at(edge, starts, counts)
    np.add.at(edge, starts + windows, -counts)
    weight = np.cumsum(edge[:-1])
    group = np.cumsum(found[:-1], dtype=np.int32) - 1
    total = np.bincount(group, weights=weight[order])
    again = np.zeros(len(s), bool)
    again[order] = total[group] >= 2
    again &= weight > 0
    return [np.flatnonzero(again[a:a + w]) for a, w in zip(starts.tolist(), windows.tolist(), strict=True)]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    if not len(x):
        return x, x
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.append(0, cut + 1)], x[np.append(cut, len(x) - 1)]


# Bits of the filter of shared anchors: a fixed size. It only thins out what is exchanged; the exact
# counts decide, so a filter too full for its input costs time and changes nothing.
FILTER_BITS = 26
BLOCK_BYTES = 3 << 18  # segments judged together; an anchor with a quarter of it is judged alone
# Different bytes of one anchor beyond which its windows are routed anew by anchors of longer grams: by
# grams 15 bytes shorter than a window, then by whole windows, of which an anchor has one.
GROUP_BYTES = 4 << 20
FINER = (15, 0)
ROW_BITS = 24  # size of the filter of documents with shared anchors


def _spans(batches, gram: int):
    """(batch, first row, data, offsets) of row spans of (__row, __text) batches."""
    for batch in batches:
        data, off = utf8_buffer(batch.column(1))
        for a, b in row_spans(off, SPAN_BYTES):
            yield batch, a, data[off[a]:off[b]], off[a:b + 1] - off[a]


def _shared_filter(base: DataFrame, length: int, gram: int) -> np.ndarray:
    """A bit for each anchor hash that occurs twice or more, by its last bits:
    anchors are least hashes, so their leading bits crowd near zero."""
    def count(batches):
        for _, _, data, off in _spans(batches, gram):
            h, n = np.unique(anchors(data, off, length, gram)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    words = (base.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
             .groupBy(F.expr(f"shiftright(h & {(1 << FILTER_BITS) - 1}L, 6)").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("bits"))
             .toArrow())  # 2 ** (FILTER_BITS - 6) rows at the most
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["w"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   gram: int | None = None) -> DataFrame:
    """For each document its id column, ``kept`` (binary: the bytes that stay,
    in order), ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``removed``
    (array of (start, end), the maximal removed runs).

    A byte goes if a string of ``length`` bytes over it also starts anywhere
    else in the texts as given, in the same document or another; matches don't
    cross documents. Null and empty texts are empty; texts shorter than
    ``length`` stay whole. Repeated rows are copies like others. Other columns
    are ignored.

    Copies of a segment are one row with a count from the first aggregation on.
    An anchor with more than GROUP_BYTES of different segments is crowded: its
    windows go to anchors of longer grams, at last to one of their own, so a
    task's work is bounded and every window is judged by the transform.
    Documents without a shared anchor lose nothing and take no part in a join."""
    spark = docs.sparkSession
    arrow_rows(spark, 500)
    gram = gram or max(1, min(GRAM, length // 4))
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    base = base.withColumn("__row", row_key("doc_id", "__text"))
    rows = base.select("__row", "__text")
    shared = spark.sparkContext.broadcast(_shared_filter(rows, length, gram))

    def find(batches):
        table, mask = shared.value, np.uint64((1 << FILTER_BITS) - 1)
        for batch, first, data, off in _spans(batches, gram):
            doc, _, lo, hi, h = anchors(data, off, length, gram)
            bit = h & mask
            sel = np.flatnonzero((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            doc, lo, hi, h = doc[sel], lo[sel], hi[sel], h[sel]
            yield _runs(batch.column(0).take(pa.array(doc + first)), lo - off[doc], hi - lo, h,
                        _digests(data.tobytes(), lo, hi + length))

    runs_ = store(rows.mapInArrow(find, RUNS), "anchors")
    touched = _row_filter(runs_)
    marked = _mark(base, touched)
    texts = marked.where("__hit").select("__row", "__text")
    segs, heads, crowded = _segments(runs_, length)
    for short in FINER:
        if not crowded.limit(1).count():
            break
        finer = _finer(texts, runs_.join(crowded, "h"), length, max(1, length - short))
        more_segs, more_heads, still = _segments(finer, length)
        runs_ = runs_.join(crowded, "h", "left_anti").unionByName(finer)
        segs = segs.join(crowded, "h", "left_anti").unionByName(more_segs)
        heads = heads.join(crowded, "h", "left_anti").unionByName(more_heads)
        crowded = still
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    # bytes of one copy of every segment, by the documents that hold them
    block = F.when(F.col("bytes") > BLOCK_BYTES // 4, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(blocks)))
    wanted = (segs.join(heads.select("h", block.alias("block")), "h")
              .groupBy(F.col("at.__row").alias("r"))
              .agg(F.collect_list(F.struct("at.lo", "at.span", "h", "seg", "n", "block")).alias("want")))

    def cut(batches):
        for batch in batches:
            out = []
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                out += [(w["block"], w["h"], w["seg"], w["n"], raw[w["lo"]:w["lo"] + w["span"] + length]) for w in want]
            if out:
                *numbers, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x, pa.int64()) for x in numbers], pa.array(raw, pa.binary())],
                    ["block", "h", "seg", "n", "bytes"])

    pieces = (texts.join(wanted, F.col("__row") == F.col("r")).select("__text", "want")
              .mapInArrow(cut, "block long, h long, seg long, n long, bytes binary"))

    def judge(table: pa.Table) -> pa.Table:
        h, seg, n = (table[c].to_numpy() for c in ("h", "seg", "n"))
        # equal rows of one id and text give a segment several times
        once = np.unique(np.stack([h, seg], 1), axis=0, return_index=True)[1]
        raw = table["bytes"].take(pa.array(once)).to_pylist()
        out = [(int(h[i]), int(seg[i]), *map(np.ndarray.tolist, runs(x)))
               for i, x in zip(once.tolist(), repeated_windows(raw, n[once], length), strict=True) if len(x)]
        return pa.table({"h": pa.array([o[0] for o in out], pa.int64()), "seg": pa.array([o[1] for o in out], pa.int64()),
                         "starts": pa.array([o[2] for o in out], pa.list_(pa.int64())),
                         "ends": pa.array([o[3] for o in out], pa.list_(pa.int64()))})

    judged = store(pieces.groupBy("block").applyInArrow(
        judge, "h long, seg long, starts array<long>, ends array<long>"), "judged")
    spans = (runs_.join(judged, ["h", "seg"])
             .select("__row", F.explode(F.arrays_zip("starts", "ends")).alias("x"), "lo")
             .select("__row", (F.col("lo") + F.col("x.starts")).alias("a"), (F.col("lo") + F.col("x.ends") + length).alias("b")))
    lost = spans.groupBy(F.col("__row").alias("r")).agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    both = marked.where("__hit").join(lost, F.col("__row") == F.col("r"), "left").select("doc_id", "__text", "lost")
    kind = docs.schema[id_col].dataType.simpleString()

    def drop(batches):
        for batch in batches:
            kept, n_bytes, n_removed, spans = [], [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                n_bytes.append(len(raw))
                joined: list = []
                for x in sorted((x["a"], x["b"]) for x in lost or ()):
                    if joined and x[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], x[1])
                    else:
                        joined.append(list(x))
                n_removed.append(sum(b - a for a, b in joined))
                edges = [0, *[v for p in joined for v in p], len(raw)]
                kept.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)) if joined else raw)
                spans.append([{"start": a, "end": b} for a, b in joined])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "removed"])

    quiet = marked.where("NOT __hit").select("doc_id", F.expr("CAST(coalesce(__text, '') AS BINARY)").alias("kept")).selectExpr(
        "doc_id", "kept", "CAST(octet_length(kept) AS BIGINT) AS n_bytes", "0L AS n_removed", "0L AS n_spans",
        "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>) AS removed")
    return both.mapInArrow(drop, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, "
                                 "removed array<struct<start: long, end: long>>").unionByName(quiet)


RUNS = "__row long, lo long, span int, h long, seg long"


def _runs(row, lo: np.ndarray, span: np.ndarray, h: np.ndarray, seg: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [row, pa.array(lo), pa.array(span.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(seg.view(np.int64))],
        ["__row", "lo", "span", "h", "seg"])


def _digests(raw: bytes, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(lo.tolist(), end.tolist(), strict=True)], np.uint64)


def _segments(runs_: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different segments with their number and one place; anchors that occur
    twice or more; of these, the crowded ones."""
    segs = store(runs_.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("__row", "lo", "span")).alias("at")),
                 "segments")
    heads = store(segs.groupBy("h").agg(F.sum("n").alias("total"), F.sum(F.col("at.span") + length).alias("bytes"))
                  .where("total > 1"), "heads")
    return segs, heads, heads.where(F.col("bytes") > GROUP_BYTES).select("h")


def _row_filter(runs_: DataFrame) -> DataFrame:
    """(w, bits) with a bit for each row of ``runs_``, by the last bits of its
    hash: 2 ** (ROW_BITS - 6) rows at the most."""
    return store(runs_.groupBy(F.expr(f"shiftright(__row & {(1 << ROW_BITS) - 1}L, 6)").alias("w"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, CAST(__row & 63 AS INT))")).alias("bits")), "rows")


def _mark(base: DataFrame, touched: DataFrame) -> DataFrame:
    """``base`` with ``__hit``: false only for rows outside the filter."""
    return (base.withColumn("w", F.expr(f"shiftright(__row & {(1 << ROW_BITS) - 1}L, 6)"))
            .join(F.broadcast(touched), "w", "left")
            .withColumn("__hit", F.expr("(coalesce(bits, 0L) & shiftleft(1L, CAST(__row & 63 AS INT))) <> 0"))
            .drop("w", "bits"))


def _finer(texts: DataFrame, crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """The windows of crowded anchors as runs of windows with one anchor of
    ``gram`` bytes. Equal windows have equal anchors again."""
    per = crowded.groupBy(F.col("__row").alias("r")).agg(F.collect_list(F.struct("lo", "span")).alias("want"))
    # rows of equal id and text have all their runs in one list, so one of the texts is cut
    one = texts.join(per, F.col("__row") == F.col("r")).select("__row", "__text", "want").dropDuplicates(["__row"])

    def part(batches):
        for batch in batches:
            for row, text, want in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                raw = (text or "").encode("utf-8")
                for k in range(0, len(want), 256):
                    at = [(w["lo"], w["lo"] + w["span"] + length) for w in want[k:k + 256]]
                    data = b"".join(raw[x:y] for x, y in at)
                    off = np.cumsum([0, *[y - x for x, y in at]])
                    seg, _, lo, hi, h = anchors(np.frombuffer(data, np.uint8), off, length, gram)
                    start = np.array([x for x, _ in at])[seg] + lo - off[seg]
                    yield _runs(pa.array(np.full(len(seg), row, np.int64)), start, hi - lo, h, _digests(data, lo, hi + length))

    return store(one.mapInArrow(part, RUNS), "finer")
