"""Sharding by a two-pass external shuffle.

Pass 1 scatters the rows into buckets that fit in memory, by a seeded hash.
Pass 2 takes each bucket whole, Fisher-Yates shuffles it and writes it. The
buckets laid end to end are a uniform order of all rows; shards are equal runs
of that order, so their row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtriage.llm.common import row_key, scratch_path, store

BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 96


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A permutation of 0 .. n - 1 (numpy's shuffle is Fisher and Yates's)."""
    return np.random.Generator(np.random.PCG64([x & (2 ** 63 - 1) for x in seed])).permutation(n)


def write_shards(docs: DataFrame, n_shards: int, path: str | None = None, seed: int = 17,
                 id_col: str = "doc_id", text_col: str = "text",
                 bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write all rows of ``docs``, whole, under ``path``/shard=<k>, with their
    place ``slot`` (from 0, without gaps) in the shard; return the path (a new
    folder in the shared checkpoint folder if none is given).

    Rows are scattered by a hash of id and text; the whole row decides the order
    before the shuffle, so a lost task writes the same rows again. Equal texts
    with other ids land anywhere; fully equal rows share a bucket. Null ids and
    texts are values like others (a null text has no bytes). Columns of ``docs``
    named shard or slot are replaced. An empty table writes no shard."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    cols = [c for c in docs.columns if c not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)) + 16
    total = docs.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    n, buckets = total["n"], max(MIN_BUCKETS, -(-(total["b"] or 0) // bucket_bytes))
    rows = docs.select(*[docs[c] for c in cols]).withColumn("__key", row_key(id_col, text_col))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(buckets)))
    # one number a bucket: where it begins in the order of all rows
    begins = store(rows.groupBy("__bucket").agg(F.count("*").alias("__n")), "buckets")
    begins = begins.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__begin"))
    placed = rows.join(begins, "__bucket")
    least, more = divmod(n, n_shards)
    edge = more * (least + 1)  # the first ``more`` shards have a row more
    types = {f.name: f for f in docs.schema}
    schema = T.StructType([types[c] for c in cols] + [T.StructField("shard", T.IntegerType()),
                                                      T.StructField("slot", T.LongType())])

    def work(table: pa.Table) -> pa.Table:
        key, bucket = table.column("__key").to_numpy(), int(table.column("__bucket")[0].as_py())
        order = np.argsort(key, kind="stable")  # equal keys are equal rows but for other columns
        order = order[fisher_yates(len(order), seed, bucket)]
        at = int(table.column("__begin")[0].as_py()) + np.arange(len(order), dtype=np.int64)
        head = at < edge
        shard = np.where(head, at // (least + 1), more + (at - edge) // max(least, 1))
        first = np.where(head, shard * (least + 1), edge + (shard - more) * least)
        return table.select(cols).take(pa.array(order)).append_column(
            "shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - first))

    out = placed.groupBy("__bucket").applyInArrow(work, schema)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    """The written rows with ``shard`` and ``slot``; ``schema`` is that of the
    table that was written."""
    fields = [f for f in schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*fields, T.StructField("slot", T.LongType()),
                                           T.StructField("shard", T.IntegerType())])).parquet(path)
