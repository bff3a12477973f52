"""Paths on whatever file system the session reads (local, HDFS, object store)."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

READY = "_READY"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``; none when it is missing."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def file_prefix(spark: SparkSession, path: str) -> str:
    """``path`` as it appears in ``_metadata.file_path`` after the scheme and host."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toUri().getRawPath().rstrip("/")


def mark_ready(spark: SparkSession, path: str) -> None:
    """Publish a version: readers skip versions without this mark."""
    fs, p = _fs(spark, f"{path}/{READY}")
    fs.create(p, True).close()


def natural(name: str) -> list:
    """Sort key that orders v=9 before v=10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", name) if x]


def latest_version(spark: SparkSession, path: str) -> str | None:
    """Newest published ``v=<n>`` folder under ``path``."""
    names = sorted((n for n in children(spark, path) if n.startswith("v=")), key=natural)
    for n in reversed(names):
        if exists(spark, f"{path}/{n}/{READY}"):
            return f"{path}/{n}"
    return None
