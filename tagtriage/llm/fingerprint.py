"""Context-triggered piecewise hashing of documents.

A hash rolling over the last seven bytes cuts a text into chunks wherever it
hits a fixed remainder modulo the block size; every chunk gives one character
of a signature. The block size follows the length of the text, and a second
signature is made at twice the size, so that texts of somewhat different
lengths can be compared: by edit distance, at a block size they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, powers, row_key, store

# The alphabet of base 64.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, SMALLEST, LENGTH = 7, 3, 64


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed 32-bit hash of the seven bytes up to each position."""
    b = data.astype(np.uint32) + np.uint32(1)
    h = b * np.uint32(0x01000193)
    c = 0x01000193
    for k in range(1, min(WINDOW, len(b))):
        c = c * 0x01000193 & 0xFFFFFFFF
        h[k:] += b[:-k] * np.uint32(c)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def signature(roll: np.ndarray, total: np.ndarray, size: int, most: int) -> str:
    """Characters of the chunks at a block size, ``most`` at the most: the last
    one stands for the rest. total: prefix sums of the bytes' polynomial."""
    n = len(roll)
    cuts = np.flatnonzero(roll % np.uint32(size) == size - 1)[:most - 1] + 1
    ends = np.append(cuts, n) if not len(cuts) or cuts[-1] < n else cuts
    starts = np.append(0, ends[:-1])
    h = (total[ends] - total[starts]) * powers(n + 1, inverse=True)[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """"<block size>:<signature>:<signature at twice the size>". The block size
    starts where 64 chunks are expected and is halved while the signature is
    shorter than 32."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    n = len(data)
    if n == 0:
        return f"{SMALLEST}::"
    roll = rolling(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n + 1)[1:], out=total[1:])
    size = SMALLEST
    while size * LENGTH < n:
        size *= 2
    sig = signature(roll, total, size, LENGTH)
    while size > SMALLEST and len(sig) < LENGTH // 2:
        size //= 2
        sig = signature(roll, total, size, LENGTH)
    return f"{size}:{sig}:{signature(roll, total, 2 * size, LENGTH // 2)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and changes, by bit-parallel columns."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if m == 0:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, dist = full, 0, m
    for c in b:
        eq = where.get(c, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        right_up, right_down = down | (full & ~(d0 | up)), up & d0
        if right_up & top:
            dist += 1
        elif right_down & top:
            dist -= 1
        right_up = (right_up << 1 | 1) & full
        right_down = right_down << 1 & full
        up, down = right_down | (full & ~(d0 | right_up)), right_up & d0
    return dist


def likeness(x: str, y: str) -> float:
    """0 to 1: one minus edit distance over length, at the block sizes that both
    fingerprints have; 0 when they share none, 1 when they are equal."""
    if x == y:
        return 1.0
    bx, x1, x2 = x.split(":")
    by, y1, y2 = y.split(":")
    bx, by = int(bx), int(by)
    if bx == by:
        pairs = [(x1, y1), (x2, y2)]
    elif bx == 2 * by:
        pairs = [(x1, y2)]
    elif by == 2 * bx:
        pairs = [(x2, y1)]
    else:
        return 0.0
    longest = sum(max(len(p), len(q)) for p, q in pairs)
    return 1 - sum(edit_distance(p, q) for p, q in pairs) / longest if longest else 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the
    following text (or all it has)."""
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def with_next(docs: DataFrame, part_bytes: int = 8 << 20, least_parts: int = 96,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ahead, doc_id, key, text): the documents in descending id, dealt in
    runs to parts, in order within each; every part ends with the document that
    follows its last one (``ahead``), which after the last is the first.

    Runs are cut at quantiles of the ids; only each part's first id goes through
    the driver. Null ids come last. Rows of one id are in the order of a hash of
    their text. A text moves once, plus one text a part."""
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", row_key("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")).cast("long"))).first()[0] or 0
    parts = max(least_parts, -(-size // part_bytes))
    ids = base.select(F.col("doc_id").cast("double").alias("doc_id"))
    cuts = ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="__id", outputCol="__range", handleInvalid="keep")
    ranged = ranges.transform(base.withColumn("__id", F.col("doc_id").cast("double")))
    last = len(splits) - 1  # Bucketizer's number for null
    ranged = ranged.withColumn("part", F.when(F.col("doc_id").isNull(), last).otherwise(
        last - 1 - F.col("__range")).cast("int")).drop("__id", "__range")
    first = F.min(F.struct(F.bitwise_not("doc_id").alias("o"), F.col("key"))).alias("f")
    heads = ranged.groupBy("part").agg(first).orderBy("part").collect()  # a row a part
    if not heads:
        return ranged.select("part", F.lit(False).alias("ahead"), "doc_id", "key", "text")
    goes = [(h["part"], h["f"]["key"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    goes = docs.sparkSession.createDataFrame(goes, "hp int, hk long, towards int")
    twice = (ranged.join(F.broadcast(goes), (F.col("part") == F.col("hp")) & (F.col("key") == F.col("hk")), "left")
             .withColumn("to", F.explode(F.expr(
                 "IF(towards IS NULL, array(struct(part AS part, false AS ahead)),"
                 " array(struct(part AS part, false AS ahead), struct(towards AS part, true AS ahead)))"))))
    return (twice.select("to.part", "to.ahead", "doc_id", "key", "text")
            .repartition(len(heads), "part")
            .sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "key"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, its fingerprint, that of its edited text (see ``edited``;
    the following document is the next in descending id, after the last the
    first), and the likeness of its fingerprint to that one and to the following
    document's: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null texts are empty. Equal texts have equal fingerprints. A single document
    follows itself. Other columns are ignored."""
    arrow_rows(docs.sparkSession, 500)
    run = with_next(docs, id_col=id_col, text_col=text_col)
    kind = run.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")

    def rows(batches) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True)

    def work(batches):
        held, out = None, []
        for part, ahead, doc_id, text in rows(batches):
            print_ = fingerprint(text)
            if held is not None and held[0] == part:
                out.append(_row(*held[1:], text, print_))
                if len(out) == 500:
                    yield _batch(out, names, kind)
                    out = []
            held = None if ahead else (part, doc_id, text, print_)
        if out:
            yield _batch(out, names, kind)

    return run.mapInArrow(work, schema)


def _row(doc_id, text, print_, next_text, next_print):
    new = edited(text, next_text)
    new_print = fingerprint(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), print_, new_print,
            likeness(print_, new_print), likeness(print_, next_print))


def _batch(rows, names, kind):
    types = [pa.int64() if kind == "bigint" else None, pa.int64(), pa.string(), pa.string(), pa.string(),
             pa.float64(), pa.float64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names)
