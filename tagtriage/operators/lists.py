"""User lists and word dictionaries (F1-F8).

Scale notes: per-user counts are partial aggregates (map-side combine), so a
user holding a third of all rows costs one pre-aggregated row per task.
List lookups are equi-joins on a unique key; AQE turns them into broadcast
joins when the list is small at run time. Messages of heavy users are dealt out
first (``hot_join``), so a fresh list costs no hot task. No list is collected
to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtriage.functions.text import tweet_tokens
from tagtriage.operators.skew import hot_join


def user_counts(df: DataFrame, label: int = 1, user: str = "user_id") -> DataFrame:
    """messages per user carrying ``label`` -> (user_id, counts)."""
    return (df.filter(F.col("label") == label)
              .groupBy(user).agg(F.count(F.lit(1)).alias("counts")))


def black_list(df: DataFrame, min_count: int = 5, user: str = "user_id") -> DataFrame:
    """users with at least ``min_count`` hijacked messages."""
    return user_counts(df, 1, user).filter(F.col("counts") >= min_count)


def white_list(df: DataFrame, min_count: int = 8, user: str = "user_id") -> DataFrame:
    """users with at least ``min_count`` valid messages."""
    return user_counts(df, 0, user).filter(F.col("counts") >= min_count)


def bl_score(df: DataFrame, bl: DataFrame, soft: bool = True,
             user: str = "user_id", out: str = "bl_label") -> DataFrame:
    """1 for a listed user, else 0.5 (soft) or -1 (hard)."""
    hit = bl.select(F.col(user), F.lit(True).alias("_bl_hit"))
    miss = 0.5 if soft else -1.0
    return (hot_join(df, hit, user, "left")
              .withColumn(out, F.when(F.col("_bl_hit"), F.lit(1.0)).otherwise(F.lit(miss)))
              .drop("_bl_hit"))


def wl_score(df: DataFrame, wl: DataFrame, words: DataFrame, soft: bool = True,
             user: str = "user_id", text: str = "processed_fulltext",
             id_col: str = "id", out: str = "wl_label") -> DataFrame:
    """0 when the user is white-listed, bl != 1 and no token of the text
    is in the hijacked-word table; else 0.5 (soft) / -1 (hard).

    Only candidate rows (listed user, bl != 1) are tokenised; their ids
    with a bad word are found by a semi join of exploded tokens against the
    word table (vocabulary-sized, so AQE broadcasts it when small).
    """
    miss = 0.5 if soft else -1.0
    hit = wl.select(F.col(user), F.lit(True).alias("_wl_hit"))
    tagged = hot_join(df, hit, user, "left")
    cand = tagged.filter(F.col("_wl_hit") & (F.col("bl_label") != 1))
    bad = (cand.select(id_col, F.explode(tweet_tokens(F.col(text))).alias("word"))
               .join(words.select("word"), "word", "left_semi")
               .select(id_col).distinct()
               .withColumn("_bad", F.lit(True)))
    return (tagged.join(bad, id_col, "left")
                  .withColumn(out, F.when(F.col("_wl_hit") & (F.col("bl_label") != 1)
                                          & F.col("_bad").isNull(), F.lit(0.0))
                                    .otherwise(F.lit(miss)))
                  .drop("_wl_hit", "_bad"))


def word_weights(df: DataFrame, text: str = "processed_fulltext", day: str = "created_at",
                 label: str = "label", total_min: float = 15.0, hijacked_min: float = 15.0,
                 valid_min: float = 20.0) -> DataFrame:
    """time-decayed token weights -> (word, total, hijacked, valid).

    Each occurrence (token length > 1) of a row from day d weighs
    ``1 - (max_day - d) / (max_day - min_day) + 1e-6``; one-day data gets
    weight ``1 + 1e-6``. Sums below their cut-off count as absent (null).
    The min/max day is a one-row aggregate joined back (bounded size).
    """
    rows = df.filter(F.col(label).isin(0, 1)).withColumn("_day", F.to_date(F.col(day)))
    span = rows.agg(F.min("_day").alias("_dmin"), F.max("_day").alias("_dmax"))
    w = (rows.crossJoin(F.broadcast(span))
             .withColumn("_span", F.datediff("_dmax", "_dmin"))
             .withColumn("_w", F.when(F.col("_span") == 0, F.lit(1.0))
                               .otherwise(1.0 - F.datediff("_dmax", "_day") / F.col("_span"))
                         + F.lit(1e-6)))
    toks = (w.select(F.col(label), F.col("_w"), F.explode(tweet_tokens(F.col(text))).alias("word"))
             .filter(F.length("word") > 1))
    agg = toks.groupBy("word").agg(
        F.sum("_w").alias("total"),
        F.sum(F.when(F.col(label) == 1, F.col("_w"))).alias("hijacked"),
        F.sum(F.when(F.col(label) != 1, F.col("_w"))).alias("valid"))
    return (agg.filter(F.col("total") >= total_min)
               .withColumn("hijacked", F.when(F.col("hijacked") >= hijacked_min, F.col("hijacked")))
               .withColumn("valid", F.when(F.col("valid") >= valid_min, F.col("valid"))))


def word_tables(weights: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(hijacked words, valid words), each (word, weight = total)."""
    ph = F.coalesce(F.col("hijacked"), F.lit(0.0)) / F.col("total")
    pv = F.coalesce(F.col("valid"), F.lit(0.0)) / F.col("total")
    base = weights.select("word", "total", ph.alias("_ph"), pv.alias("_pv"))
    hij = base.filter((F.col("_ph") > F.col("_pv")) & (F.col("_ph") >= threshold))
    val = base.filter((F.col("_pv") > F.col("_ph")) & (F.col("_pv") >= threshold))
    return (hij.select("word", F.col("total").alias("weight")),
            val.select("word", F.col("total").alias("weight")))


def word_table_kinds(weights: DataFrame, threshold: float = 0.8) -> DataFrame:
    """F7 in one frame: (word, kind in {'hijacked','valid'}, weight)."""
    ph = F.coalesce(F.col("hijacked"), F.lit(0.0)) / F.col("total")
    pv = F.coalesce(F.col("valid"), F.lit(0.0)) / F.col("total")
    kind = (F.when((ph > pv) & (ph >= threshold), F.lit("hijacked"))
             .when((pv > ph) & (pv >= threshold), F.lit("valid")))
    return (weights.select("word", kind.alias("kind"), F.col("total").alias("weight"))
                   .filter(F.col("kind").isNotNull()))


def upsert(old: DataFrame, new: DataFrame, key: str = "word", value: str = "weight") -> DataFrame:
    """F8: keep old entries, new values overwrite (full outer join)."""
    o = old.select(F.col(key), F.col(value).alias("_old"))
    n = new.select(F.col(key), F.col(value).alias("_new"))
    return (o.join(n, key, "full_outer")
             .select(key, F.coalesce("_new", "_old").alias(value)))
