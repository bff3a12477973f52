"""Message files: JSON lines in, JSON / CSV / Parquet out."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtriage.session import checkpoint_dir
from tagtriage.sources.storage import file_prefix

# Raw nested message schema (explicit: no inference pass over the data).
HASHTAGS = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))
URLS = T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))
ENTITIES = T.StructType([T.StructField("hashtags", HASHTAGS), T.StructField("urls", URLS)])
RAW_SCHEMA = T.StructType([
    T.StructField("created_at", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("in_reply_to_status_id", T.LongType()),
    T.StructField("retweeted_status", T.StructType([T.StructField("id", T.LongType())])),
    T.StructField("favorite_count", T.LongType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("quote_count", T.LongType()),
    T.StructField("user", T.StructType([
        T.StructField("id", T.LongType()), T.StructField("verified", T.BooleanType()),
        T.StructField("friends_count", T.LongType()), T.StructField("followers_count", T.LongType()),
        T.StructField("created_at", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("statuses_count", T.LongType())])),
    T.StructField("entities", ENTITIES),
    T.StructField("extended_tweet", T.StructType([T.StructField("full_text", T.StringType()),
                                                  T.StructField("entities", ENTITIES)])),
])


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    return os.path.join(checkpoint_dir(spark), name, uuid.uuid4().hex)


def read_messages(spark: SparkSession, path, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """A1 / A3: JSON lines (one path, a glob or a list of paths) with an
    explicit schema."""
    return spark.read.schema(schema).json(path)


def read_raw(spark: SparkSession, path, schema: T.StructType = RAW_SCHEMA,
             on_error: str = "drop") -> DataFrame | tuple[DataFrame, DataFrame]:
    """A2: skip malformed lines (``drop``), or return (good, bad) where bad
    holds the raw text of each malformed line (``quarantine``). Both are lazy:
    lines are parsed where they are read, nothing is cached."""
    if on_error == "drop":
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    s = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\S"))
    row = F.from_json("value", s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    allrows = lines.select(row.alias("r")).select("r.*")
    good = allrows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = allrows.filter(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def read_tagged(spark: SparkSession, tags: dict[str, str], schema: T.StructType = RAW_SCHEMA,
                col: str = "category") -> DataFrame:
    """A4: read several files or folders, each row tagged with the category of
    the path it came from (the longest one given). Paths are compared whole,
    so equal file names in different folders keep their own tags; a row whose
    file matches no path is an error."""
    df = spark.read.schema(schema).json(list(tags))
    file = F.regexp_replace(F.col("_metadata.file_path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    prefixes = {file_prefix(spark, p): v for p, v in tags.items()}
    tag = None
    for p in sorted(prefixes, key=len, reverse=True):
        hit = (file == p) | file.startswith(p + "/")
        tag = F.when(hit, prefixes[p]) if tag is None else tag.when(hit, prefixes[p])
    untagged = F.raise_error(F.concat(F.lit("no tag for "), file)).cast("string")
    return df.withColumn(col, tag.otherwise(untagged))


def read_by_prefix(spark: SparkSession, path: str, schema, level: str = "file") -> DataFrame:
    """A5: every file under ``path``; category = name up to the first '-'
    of the file (``level='file'``) or of its parent folder (``'folder'``,
    for files written by Spark, whose part files carry generated names);
    keeps id, fulltext and category."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    name = (F.col("_metadata.file_name") if level == "file"
            else F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
    return df.select("id", "fulltext", F.substring_index(name, "-", 1).alias("category"))


def parse_json_column(df: DataFrame, col: str, schema: str, out: str | None = None) -> DataFrame:
    """Parse a JSON string column into a struct (missing fields -> null)."""
    return df.withColumn(out or col, F.from_json(F.col(col), schema))


def write_messages(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """JSON lines, CSV (with header; arrays joined by '|') or Parquet."""
    w = df
    if fmt == "csv":
        for f in df.schema.fields:
            if isinstance(f.dataType, T.ArrayType):
                w = w.withColumn(f.name, F.array_join(F.col(f.name).cast("array<string>"), "|"))
            elif isinstance(f.dataType, (T.StructType, T.MapType)):
                w = w.withColumn(f.name, F.to_json(F.col(f.name)))
    writer = w.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
