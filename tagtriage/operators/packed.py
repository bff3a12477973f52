"""Sparse vectors packed by document, in blocks that share a list of terms.

A row a term costs a shuffle and a sort of all non-zeros for every step that
looks a term up. Here a block holds some documents and its distinct terms once;
its documents hold places in that list. A lookup (of an idf weight, of a
centre's entries) moves a row for each term of a block, about a tenth of the
non-zeros, and meets the documents in one task a block. Blocks are bounded by
``BLOCK`` non-zeros, not by the input's size (one document is never divided).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtriage.session import stored

# tokens or entries of a block, and rows of an Arrow batch that leaves a task
BLOCK, CHUNK = 8_000_000, 50_000


def _lists(values, starts) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


def _spread(col: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All entries of a list column, and the row of each."""
    one = col.combine_chunks()
    one = pa.concat_arrays(one.chunks) if isinstance(one, pa.ChunkedArray) else one
    return one.flatten(), np.repeat(np.arange(len(one)), one.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _packer(counted: bool, limit: int):
    """Arrow batches (doc, terms[, values]) to blocks: (block, doc, idx, val, terms,
    df, total); the last three are in a block's first row and empty in others. Rows
    of one document follow each other and are put together."""
    def block(held, number):
        tab = pa.Table.from_batches(held)
        tab = tab.filter(pc.greater(pc.list_value_length(tab.column(1)), 0))
        words, row = _spread(tab.column(1))
        docs = tab.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        row, ids = docs.indices.to_numpy(zero_copy_only=False)[row], docs.dictionary
        enc = words.dictionary_encode(null_encoding="encode")
        terms, k = enc.dictionary, len(enc.dictionary)
        idx = enc.indices.to_numpy(zero_copy_only=False)
        if counted:
            key, val = np.unique(row * np.int64(k) + idx, return_counts=True)
            row, idx = np.divmod(key, k)
            df, total = np.bincount(idx, minlength=k), np.bincount(idx, weights=val, minlength=k).astype("int64")
            val = val.astype("int32")
        else:
            val, df, total = _spread(tab.column(2))[0], np.zeros(k, "int64"), np.zeros(k, "int64")
        n = len(ids)
        starts = np.searchsorted(row, np.arange(n + 1))
        first = np.r_[0, np.full(n, k)]
        out = pa.table({"block": pa.array(np.full(n, number, "int64")), "doc": ids,
                        "idx": _lists(idx.astype("int32"), starts), "val": _lists(val, starts), "terms": _lists(terms, first),
                        "df": _lists(df.astype("int64"), first), "total": _lists(total, first)})
        return out.to_batches(max_chunksize=1000)

    def pack(batches):
        from pyspark import TaskContext
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += len(b.column(1).flatten())
            if size >= limit:
                last = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                ended = int(np.searchsorted(last == last[-1], True)) if len(last) else 0  # its rows are the batch's last
                if not ended:  # one document fills the batch: it goes on, or ends with the next
                    continue
                yield from block([*held[:-1], b.slice(0, ended)], task << 32 | made)
                rest = b.slice(ended)
                made, held, size = made + 1, [rest], len(rest.column(1).flatten())
        if size:
            yield from block(held, task << 32 | made)
    return pack


@dataclass
class Packed:
    """``docs``: (block, doc, idx, val, terms, df, total), stored. ``weights``: (block,
    idx, term, w), what an entry's value is multiplied by; entries whose term has no
    row there drop out. None leaves the values. ``normalise``: to length one."""

    docs: DataFrame
    doc: str
    weights: DataFrame | None = None
    normalise: bool = False

    def terms(self) -> DataFrame:
        """(block, idx, term, df, total), a row for each term of a block."""
        return (self.docs.filter(F.size("terms") > 0)
                .select("block", F.posexplode(F.arrays_zip("terms", "df", "total")).alias("idx", "_t"))
                .select("block", "idx", F.col("_t.terms").alias("term"), "_t.df", "_t.total"))

    def by_block(self, fn: Callable, schema: T.StructType, other: DataFrame | None = None) -> DataFrame:
        """``fn(doc, row, idx, value, terms, other)`` of every block, as arrays: the ids of
        its documents; row in that list, place among the terms and value of each
        entry; its terms; the block's rows of ``other`` (block, idx, w, ...), the
        weights unless another table holds them too. It gives an Arrow table."""
        right = other if other is not None else self.weights if self.weights is not None else self.terms().select("block", "idx", F.lit(1.0).alias("w"))
        normalise = self.normalise

        def work(left, given):
            terms = _spread(left.column("terms"))[0]
            idx, row = _spread(left.column("idx"))
            idx = idx.to_numpy(zero_copy_only=False)
            val = _spread(left.column("val"))[0].to_numpy(zero_copy_only=False).astype("float64")
            w, known = np.zeros(len(terms)), np.zeros(len(terms), bool)
            at = given.column("idx").to_numpy()
            w[at], known[at] = given.column("w").to_numpy(), True
            keep = known[idx]
            row, idx, val = row[keep], idx[keep], val[keep] * w[idx[keep]]
            if normalise:
                norm = np.sqrt(np.bincount(row, val * val, minlength=left.num_rows))
                val = np.divide(val, norm[row], out=np.zeros_like(val), where=norm[row] > 0)
            return fn(left.column("doc"), row, idx, val, terms, given)

        left = self.docs.select("block", "doc", "idx", "val", "terms")
        right = right.withColumn("_block", F.col("block") + 0).drop("block")  # a column of its own, for Spark to tell the sides apart
        return left.groupBy("block").cogroup(right.groupBy("_block")).applyInArrow(work, schema)

    def long(self) -> DataFrame:
        """(doc, term, value), a row an entry."""
        kind = self.docs.schema["doc"].dataType

        def rows(doc, row, idx, val, terms, given):
            parts = [pa.table({self_doc: doc.take(pa.array(row[i:i + CHUNK])), "term": terms.take(pa.array(idx[i:i + CHUNK])),
                               "value": pa.array(val[i:i + CHUNK])}) for i in range(0, max(1, len(row)), CHUNK)]
            return pa.concat_tables(parts)

        self_doc = self.doc
        return self.by_block(rows, T.StructType([T.StructField(self.doc, kind), T.StructField("term", T.StringType()), T.StructField("value", T.DoubleType())]))

    def of(self, some: DataFrame) -> DataFrame:
        """(*columns of some, term, value) of a few documents; ``some``: (doc, ...), small."""
        picked = self.docs.join(F.broadcast(some.withColumnRenamed(self.doc, "doc")), "doc")
        flat = picked.select("block", *[c if c != self.doc else "doc" for c in some.columns], F.explode(F.arrays_zip("idx", "val")).alias("_e"))
        table = self.weights if self.weights is not None else self.terms().withColumn("w", F.lit(1.0)).select("block", "idx", "term", "w")
        out = (flat.withColumn("idx", F.col("_e.idx")).join(table, ["block", "idx"])
               .withColumn("value", F.col("_e.val") * F.col("w")).withColumnRenamed("doc", self.doc))
        if self.normalise:
            from tagtriage.operators.features import l2_normalise
            out = l2_normalise(out, self.doc)
        return out.select(*some.columns, "term", "value")


def _schema(kind: T.DataType, value: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    cols = {"block": T.LongType(), "doc": kind, "idx": T.ArrayType(T.IntegerType()), "val": T.ArrayType(value),
            "terms": T.ArrayType(T.StringType()), "df": longs, "total": longs}
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


def pack_texts(df: DataFrame, text: str, doc: str, tokens: Callable[[Column], Column]) -> Packed:
    """Term counts of texts. They are dealt out by document first, so texts move
    and no row a token is made; rows of one document count together."""
    rows = df.repartition(doc).sortWithinPartitions(doc).select(doc, tokens(F.col(text)).alias("_words"))
    return Packed(stored(rows.mapInArrow(_packer(True, BLOCK), _schema(df.schema[doc].dataType, T.IntegerType()))), doc)


def pack_rows(vectors: DataFrame, doc: str = "id") -> Packed:
    """Vectors given as (doc, term, value), a row a term."""
    rows = (vectors.repartition(doc).sortWithinPartitions(doc)
            .select(doc, F.array("term").alias("term"), F.array(F.col("value").cast("double")).alias("value")))
    return Packed(stored(rows.mapInArrow(_packer(False, BLOCK), _schema(vectors.schema[doc].dataType, T.DoubleType()))), doc)
