"""Row cleaning, projection and filters.

Strict unique (B1) counts keys only: partial counts combine map-side, so even a
key repeated across a third of the rows reaches the shuffle as one row per
task. The repeated keys are stored and anti-joined, so Spark broadcasts them
when they are few and splits a hot key's rows when they are not; the wide rows
are never sorted or aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.session import cut_lineage


def strict_unique(df: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """B1: drop *every* copy of a repeated key (pandas ``keep=False``)."""
    keys = [key] if isinstance(key, str) else list(key)
    repeated = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
                             .select(*[F.col(c).alias(f"_key_{c}") for c in keys]))
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]  # repeated nulls are copies too
    return df.join(repeated, same, "left_anti")


def exclude_ids(df: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """B2: drop a fixed block-list of ids (literal list -> pushed filter)."""
    return df.filter(~F.col(key).isin(*ids)) if ids else df


def drop_retweets(df: DataFrame) -> DataFrame:
    """Drop rows with a retweeted status."""
    return df.filter(F.col("retweeted_status.id").isNull())


def drop_replies(df: DataFrame) -> DataFrame:
    """Drop replies."""
    return df.filter(F.col("in_reply_to_status_id").isNull())


def full_text(truncated="truncated", text="text", ext="extended_tweet.full_text") -> Column:
    """``text`` unless truncated, then the extended full text."""
    return F.when(~F.col(truncated), F.col(text)).otherwise(F.col(ext))


def hashtags() -> Column:
    """Hashtag texts from the entity list that belongs to the full text."""
    return F.coalesce(
        F.when(F.col("truncated"), F.col("extended_tweet.entities.hashtags"))
         .otherwise(F.col("entities.hashtags")),
        F.array().cast("array<struct<text:string>>"))


def hashtag_texts() -> Column:
    return F.transform(hashtags(), lambda h: h["text"])


def urls() -> Column:
    """URL strings of the matching entity list (null -> empty)."""
    ent = F.coalesce(F.when(F.col("truncated"), F.col("extended_tweet.entities.urls"))
                      .otherwise(F.col("entities.urls")),
                     F.array().cast("array<struct<url:string>>"))
    return F.transform(ent, lambda u: u["url"])


def hashtag_count(tags: Column) -> Column:
    """Number of hashtags, null -> 0."""
    return F.coalesce(F.size(tags), F.lit(0)).cast("int")


def parse_ts(c) -> Column:
    """Parse ``EEE MMM dd HH:mm:ss Z yyyy`` (the weekday is skipped
    because Spark 3+ rejects ``EEE`` when parsing)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.to_timestamp(F.substring(col, 5, 100), "MMM dd HH:mm:ss Z yyyy")


def year_month(ts) -> Column:
    """``'{year}-{month}'`` without zero padding."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.concat_ws("-", F.year(col).cast("string"), F.month(col).cast("string"))


CANONICAL = ["id", "user_id", "created_at", "fulltext", "hashtags", "urls",
             "number_of_hashtags", "favorite_count", "retweet_count", "quote_count",
             "user_verified", "user_friends_count", "user_followers_count",
             "user_created_at", "user_description", "user_statuses_count", "month"]


def project_canonical(df: DataFrame) -> DataFrame:
    """Flatten a raw nested message to the canonical columns."""
    tags = hashtag_texts()
    return df.select(
        F.col("id"), F.col("user.id").alias("user_id"),
        parse_ts("created_at").alias("created_at"),
        full_text().alias("fulltext"), tags.alias("hashtags"), urls().alias("urls"),
        hashtag_count(tags).alias("number_of_hashtags"),
        "favorite_count", "retweet_count", "quote_count",
        F.col("user.verified").alias("user_verified"),
        F.col("user.friends_count").alias("user_friends_count"),
        F.col("user.followers_count").alias("user_followers_count"),
        parse_ts("user.created_at").alias("user_created_at"),
        F.col("user.description").alias("user_description"),
        F.col("user.statuses_count").alias("user_statuses_count"),
        year_month(parse_ts("created_at")).alias("month"))


def drop_suffix(df: DataFrame, suffix: str = "_y") -> DataFrame:
    """Drop columns whose name ends with ``suffix``."""
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def word_in_text(df: DataFrame, word: str, text: str = "fulltext") -> DataFrame:
    """Rows whose text contains ``word`` (case-insensitive regex)."""
    return df.filter(F.lower(F.col(text)).rlike(word.lower()))


def track(df: DataFrame, lang: str, terms: list[str], lang_col: str = "lang",
          text: str = "fulltext") -> DataFrame:
    """Language filter plus any tracked term (case-insensitive)."""
    low = F.lower(F.col(text))
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))
    return df.filter((F.col(lang_col) == lang) & hit)


def rule_scan(df: DataFrame, rules: DataFrame, cap: int, tags: str = "hashtags",
              ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """Rows matching a rule (any of its hashtags, case-insensitive) in
    the rule's month range, at most ``cap`` per (rule, month), earliest ids
    first. ``rules``: (rule string, tag string, start timestamp, end timestamp),
    one row per tag. The cap is the operator's feature (a bounded pull)."""
    ex = (df.select(id_col, ts, F.explode(F.col(tags)).alias("_tag"))
            .withColumn("_tag", F.lower("_tag")))
    r = rules.withColumn("tag", F.lower("tag"))
    hit = (ex.join(r, ex["_tag"] == r["tag"])
             .filter((F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end")))
             .select(id_col, ts, "rule").distinct()
             .withColumn("month", year_month(ts)))
    from tagtriage.operators.ranking import top_n_per_group
    return top_n_per_group(hit, ["rule", "month"], [F.col(id_col)], cap)


def order_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Sort by id (use only right before a sink)."""
    return df.orderBy(key)


def distribution(df: DataFrame, group: str, key: str = "id") -> DataFrame:
    """Distinct ids per group (exact count distinct, two-level agg)."""
    return df.groupBy(group).agg(F.countDistinct(key).alias("n"))


def clean_seed(raw: DataFrame, block_ids: list[int] | None = None) -> DataFrame:
    """B2 -> B1 -> B3 -> B4 -> B5..B11 on a raw nested feed."""
    df = exclude_ids(raw, block_ids or [])
    df = strict_unique(df, "id")
    df = drop_replies(drop_retweets(df))
    return project_canonical(df)
