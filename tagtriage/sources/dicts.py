"""List and word tables on storage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtriage.sources.storage import exists, latest_version, mark_ready

__all__ = ["latest_version", "load_counts_txt", "load_dict", "save_dict"]

USER_LIST_SCHEMA = "user_id long, counts long"
WORD_TABLE_SCHEMA = "word string, weight double"


def load_dict(spark: SparkSession, path: str, schema: str = USER_LIST_SCHEMA) -> DataFrame:
    """A saved table, or an empty one when there is no path yet (a first
    run). A path that is there but can't be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    cols = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.read.parquet(path).select(*cols)


def load_counts_txt(spark: SparkSession, path: str) -> DataFrame:
    """Lines 'key value' -> (user_id, counts)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return (spark.read.text(path)
                 .filter(F.trim("value") != "")
                 .select(parts[0].cast("long").alias("user_id"), parts[1].cast("long").alias("counts")))


def save_dict(df: DataFrame, path: str, version: str | None = None) -> str:
    """A10: overwrite a table; with ``version`` it goes to ``path/v=<version>``
    so readers of the previous version are never disturbed."""
    target = os.path.join(path, f"v={version}") if version else path
    df.write.mode("overwrite").parquet(target)
    if version:
        mark_ready(df.sparkSession, target)
    return target

