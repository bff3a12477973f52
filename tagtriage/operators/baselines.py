"""Baselines (K1-K6). Class statistics are one small aggregate (one row per
class, a bounded table) broadcast to the rows being labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.operators import features as fe
from tagtriage.operators.sampling import uniform
from tagtriage.session import cut_lineage


def baseline_random(train: DataFrame, test: DataFrame, seed: int = 0, label: str = "label",
                    key: str = "id", out: str = "pred", hash: str = "xx") -> DataFrame:
    """K1: a seeded random choice among the distinct training labels."""
    labs = train.agg(F.array_sort(F.collect_set(label)).alias("_labs"))
    return (test.crossJoin(F.broadcast(labs))
                .withColumn(out, F.element_at("_labs", (F.floor(uniform(key, seed, hash) * F.size("_labs")) + 1)
                                              .cast("int")))
                .drop("_labs"))


def _by_count(train, label, ascending):
    c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    o = F.col("_n").asc() if ascending else F.col("_n").desc()
    return c.orderBy(o, F.col(label)).limit(1).select(F.col(label).alias("_lab"))


def baseline_mode(train: DataFrame, test: DataFrame, label: str = "label",
                  out: str = "pred") -> DataFrame:
    """K2: zero rule -- the most common training label (ties: smallest)."""
    return test.crossJoin(F.broadcast(_by_count(train, label, False))).withColumnRenamed("_lab", out)


def baseline_min(train: DataFrame, test: DataFrame, label: str = "label",
                 out: str = "pred") -> DataFrame:
    """K3: the least common training label (ties: smallest)."""
    return test.crossJoin(F.broadcast(_by_count(train, label, True))).withColumnRenamed("_lab", out)


def baseline_mean(train: DataFrame, test: DataFrame, label: str = "label",
                  out: str = "pred") -> DataFrame:
    """K4: the mean training label."""
    m = train.agg(F.avg(F.col(label).cast("double")).alias(out))
    return test.crossJoin(F.broadcast(m))


def baseline_topic(topic: DataFrame, general: DataFrame, test: DataFrame, text: str,
                   key: str = "id", top: int = 10, need: int = 5, out: str = "pred") -> DataFrame:
    """K5: TF-IDF over two pseudo-documents (all topic text, all general
    text); a test text is valid (0) when at least ``need`` of its ``top``
    heaviest terms are among the topic document's ``top`` terms, else 1.
    Only non-zero terms take part (the reference pads with zero-score ones).
    """
    pseudo = (topic.select(F.lit(0).alias("pd"), F.col(text).alias("t"))
                   .unionByName(general.select(F.lit(1).alias("pd"), F.col(text).alias("t"))))
    tc = cut_lineage(fe.term_counts(pseudo, "t", doc="pd"))
    idf = cut_lineage(fe.idf_table(tc, n_docs=2, doc="pd"))
    # a document's norm doesn't change the order of its terms
    topic_top = (fe.top_terms(fe.tfidf(tc, doc="pd", idf=idf, normalise=False), top, doc="pd")
                   .filter(F.col("pd") == 0).select("term", F.lit(True).alias("_in_topic")))
    ttc = fe.term_counts(test, text, doc=key, by_doc=True)  # a row a term stays where its text is
    tv = fe.tfidf(ttc, doc=key, idf=idf, normalise=False)
    tt = fe.top_terms(tv, top, doc=key).join(F.broadcast(topic_top), "term", "left")
    hits = tt.groupBy(key).agg(F.count("_in_topic").alias("_hits"))
    return (test.join(hits, key, "left")
                .withColumn(out, F.when(F.coalesce("_hits", F.lit(0)) >= need, 0).otherwise(1))
                .drop("_hits"))


def known_label(df: DataFrame, known: DataFrame, key: str = "id", label: str = "label",
                out: str = "known") -> DataFrame:
    """K6: the known label of a row, else -1."""
    k = known.select(F.col(key), F.col(label).alias("_k"))
    return df.join(k, key, "left").withColumn(out, F.coalesce("_k", F.lit(-1))).drop("_k")
