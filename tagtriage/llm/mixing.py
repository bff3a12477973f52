"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is the size it should have over the size it
has. Each document draws its number of copies by inverting the Poisson
distribution with that mean at a number hashed from seed and id, is exploded by
it, and the copies are put into a global hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.llm.common import store

ALPHA, SEED = 0.7, 11


def uniform(seed: int, *parts: Column) -> Column:
    """[0, 1) from the first 52 bits of an MD5 over seed and parts."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """Smallest k with P(X <= k) > u for X ~ Poisson(rate): the probabilities,
    kept as logarithms, are summed in order up to where the rest is below 2^-52."""
    most = (rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.lit(0).alias("k"), (-rate).alias("lp"), F.exp(-rate).alias("c"))
    end = F.aggregate(
        F.sequence(F.lit(1), most), start,
        lambda s, j: F.when(s["c"] > u, s).otherwise(F.struct(
            j.alias("k"), (s["lp"] + F.log(rate) - F.log(j)).alias("lp"),
            (s["c"] + F.exp(s["lp"] + F.log(rate) - F.log(j))).alias("c"))),
        lambda s: s["k"])
    return F.when(rate > 0, end).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, rate): one row a source. Sizes are UTF-8 bytes. Target weights are
    the given ones (a source without one gets none), or else size ** alpha; the
    mixture has the size of the input. A null source is a source of its own
    (named None in ``weights``). A source without any bytes gets rate 0."""
    size = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long")
    per = docs.groupBy(docs[source_col].alias("__source")).agg(F.sum(size).alias("__b"))
    if weights is None:
        per = per.withColumn("__w", F.pow(F.col("__b").cast("double"), F.lit(alpha)))
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
        per = per.withColumn("__w", w)
    per = store(per, "sources")
    total = per.agg(F.sum("__b").alias("b"), F.sum("__w").alias("w"))
    return per.crossJoin(F.broadcast(total)).select(
        "__source", F.when((F.col("__b") > 0) & (F.col("w") > 0), F.round(
            F.col("__w") / F.col("w") * F.col("b") / F.col("__b"), 9)).otherwise(0.0).alias("__rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies of all documents, in a global hash order: the columns of
    ``docs`` plus ``copy`` (int, from 1) and ``place`` (the hash that orders).

    Rows with equal ids draw alike; a null id draws by its text. Empty texts
    count no bytes but are drawn like others of their source. Columns of
    ``docs`` named copy or place are replaced. Sources meet their rate by a join
    that Spark splits where a source is hot; copies are spread by their hash."""
    cols = [c for c in docs.columns if c not in ("copy", "place")]
    per = store(rates(docs, weights, alpha, source_col, text_col), "rates")
    named = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("text "), F.md5(
        F.coalesce(docs[text_col].cast("string"), F.lit("")))))
    rows = docs.select(*[docs[c] for c in cols], docs[source_col].alias("__key"), named.alias("__named"))
    rows = rows.join(per, F.col("__key").eqNullSafe(F.col("__source")))
    rows = rows.withColumn("__n", poisson_quantile(uniform(seed, F.col("__named")), F.col("__rate")))
    rows = rows.where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    rows = rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), "__named",
                                                      F.col("copy").cast("string"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select(*[F.col(f"`{c}`") for c in cols], "copy", "place")
            .repartitionByRange(parts, "place").sortWithinPartitions("place"))
