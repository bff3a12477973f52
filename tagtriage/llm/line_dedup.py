"""Line dedup: explode normalised lines, hash them, count the distinct documents
of each hash, drop the lines over the threshold, reassemble by position."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import arrow_rows, row_key, store

MIN_CHARS, MIN_DOCS = 20, 3
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(__doc, __row, pos, h1, h2) of every line whose key is long enough. Two
    seeded 64-bit hashes stand for the key."""
    key = F.transform(F.split(F.coalesce("__text", F.lit("")), "\n"), line_key)
    return (docs.select("__doc", "__row", F.posexplode(key).alias("pos", "key"))
            .where(F.length("key") >= min_chars)
            .select("__doc", "__row", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(1), "key").alias("h2")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the repeated lines taken out of the text, plus
    ``n_lines`` (before) and ``n_dropped`` (long).

    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents loses all its lines except in the largest id holding it. Rows with
    equal id and text are one document, and share their fate. A null id is
    smaller than any other; a key only in documents without id keeps its lines.
    Null and empty texts are one empty line and stay as they are. Columns of
    ``docs`` named n_lines or n_dropped are replaced.

    Plan: the exploded hashes are stored once; the counts are partial sums, so a
    line in every document reaches the shuffle as a row per task; the counted
    keys are stored, so Spark splits a hot key's side of the join. Texts are
    shuffled once, to meet the positions that they lose."""
    arrow_rows(docs.sparkSession)
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    base = docs.select(*[docs[c] for c in cols], docs[id_col].alias("__doc"),
                       docs[text_col].cast("string").alias("__text"))
    base = base.withColumn("__row", row_key("__doc", "__text"))
    lines = store(_lines(base, min_chars), "lines")
    repeated = store(lines.groupBy("h1", "h2")
                     .agg(F.count_distinct("__row").alias("n"), F.max("__doc").alias("last"))
                     .where((F.col("n") >= min_docs) & F.col("last").isNotNull())
                     .select("h1", "h2", "last"), "repeated-lines")
    lost = (lines.join(repeated, ["h1", "h2"])
            .where(F.col("__doc").isNull() | (F.col("__doc") < F.col("last")))
            .groupBy(F.col("__row").alias("__lost_row"), F.col("__doc").alias("__lost_doc"))
            .agg(F.collect_set("pos").alias("__lost")))
    both = (base.join(lost, (F.col("__row") == F.col("__lost_row"))
                      & F.col("__doc").eqNullSafe(F.col("__lost_doc")), "left")
            .select(*[F.col(f"`{c}`") for c in cols if c != text_col], "__text", "__lost"))
    rest = [c for c in cols if c != text_col]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in rest] + [f"`{text_col}` string", "n_lines long", "n_dropped long"])

    def work(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist(), strict=True):
                n_lines.append(text.count("\n") + 1 if text else 1)
                n_dropped.append(len(lost) if lost else 0)
                if lost:
                    lost = set(lost)
                    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in lost])
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(rest))]
                + [pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*rest, text_col, "n_lines", "n_dropped"])

    out = both.mapInArrow(work, schema)
    return out.select(*[F.col(f"`{c}`") for c in cols], "n_lines", "n_dropped")
