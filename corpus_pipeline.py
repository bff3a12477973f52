"""Corpus pipeline: from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and is written as Parquet before the next reads it. All but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtriage.llm import bpe, line_dedup, mixing, probminhash, quality
from tagtriage.llm.common import store
from tagtriage.sources.tables import table


# the columns that the operators read; all others travel under names that no operator writes
READ = ("doc_id", "text", "source")


def _apart(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"__in{i}") for i, c in enumerate(docs.columns)])


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with their names and values; ``n_chars`` is counted
    anew where the table has it, as the text may have changed."""
    cols = [F.col(c if c in READ else f"__in{i}").alias(c) for i, c in enumerate(docs.columns)]
    out = out.select(*cols)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))
    return out


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the grade "good" is one half or more; the
    classifier is fitted on a bounded sample of ``labels``."""
    marks = table(spark, sf_dir, "labels").select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    rows = _apart(docs)
    kept = quality.classify(rows, quality.train(rows, marks)).where("keep")
    return kept.select(*[F.col(c).alias(d) for c, d in zip(rows.columns, docs.columns, strict=True)])


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that three or more documents share, but for the last
    document; every document stays, if only with what is left of it."""
    return _back(line_dedup.drop_repeated_lines(_apart(docs)), docs)


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return probminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources weigh as size ** 0.7, in a global order."""
    rows = _apart(docs)
    return mixing.mix(rows).select(*[F.col(c).alias(d) for c, d in zip(rows.columns, docs.columns, strict=True)])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, with digests of the ids and of the decoded bytes."""
    return bpe.encode_decode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                     keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("near-duplicate dedup", near_filter),
    ("source mixing", mix_sources),
    ("byte-level BPE", tokens),
]

# ProbMinHash signatures and BPE merges have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
