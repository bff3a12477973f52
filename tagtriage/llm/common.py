"""Shared helpers: scratch tables, Arrow batches, Arrow text buffers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtriage.session import checkpoint_dir

ARROW_ROWS = 1000


def arrow_rows(spark: SparkSession, n: int = ARROW_ROWS) -> None:
    """Rows per Arrow batch: a Python worker holds one batch of texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/tagtriage-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage, survives lost executors, and gives later joins a plain scan whose
    shuffle Spark can split where a key is hot."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> Column:
    """64-bit hash of the named columns; nulls hash like a missing column, so
    the names' order and the null pattern are hashed too."""
    parts = [F.lit(len(cols))]
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def utf8_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying the texts;
    nulls are empty. offsets has one entry more than rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        if arr.null_count:
            arr = arr.fill_null("")
    elif arr.null_count:
        arr = arr.fill_null(b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    base = int(off[0])
    return data[base:int(off[-1])], off - base


def row_spans(offsets: np.ndarray, limit: int):
    """Consecutive row ranges [a, b) whose texts hold about ``limit`` bytes
    (a longer text stands alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """_BASE ** i modulo 2 ** 64 (or of its inverse), kept for the next call."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = np.uint64(base)
        _POWERS[inverse] = have = np.multiply.accumulate(have)
    return have[:n]
