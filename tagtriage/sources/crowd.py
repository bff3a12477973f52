"""Crowd tasks: export and result ingest, engagement lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: question template slot and link markup ---
TEMPLATE_SLOT = "${text}"
TEMPLATE = "<classification-target> ${text} </classification-target>"


def attach_engagement(df: DataFrame, counts: DataFrame, key: str = "id",
                      cols: tuple[str, ...] = ("favorite_count", "retweet_count")
                      ) -> tuple[DataFrame, DataFrame]:
    """Add engagement counts looked up by id (missing -> 0); the ids
    that could not be looked up form the rejects table."""
    c = counts.select(key, *cols)
    ok = df.join(c, key, "left")
    for x in cols:
        ok = ok.withColumn(x, F.coalesce(F.col(x), F.lit(0)))
    rejects = df.join(c.select(key), key, "left_anti")
    return ok, rejects


def link_urls(text, urls) -> F.Column:
    """Wrap every URL of the row in an HTML link."""
    t = F.col(text) if isinstance(text, str) else text
    u = F.coalesce(F.col(urls) if isinstance(urls, str) else urls, F.array().cast("array<string>"))
    return F.aggregate(u, t, lambda acc, x: F.replace(
        acc, x, F.concat(F.lit(' <a href="'), x, F.lit('"target="_blank"> '), x, F.lit(" </a> "))))


def export_tasks(df: DataFrame, text: str = "fulltext", urls: str = "urls",
                 template: str = TEMPLATE, id_col: str = "id") -> DataFrame:
    """ASCII-only text with live links, placed in the question template."""
    ascii_text = F.regexp_replace(F.col(text), r"[^\x00-\x7F]", "")
    body = link_urls(ascii_text, urls)
    return df.select(F.col(id_col).alias("tweet_id"),
                     F.replace(F.lit(template), F.lit(TEMPLATE_SLOT), body).alias("question"))


def answer_code(answer) -> F.Column:
    """A15: 'Yes' -> 1, else containing 'No' -> -1, else 0."""
    a = F.col(answer) if isinstance(answer, str) else answer
    return (F.when(F.contains(a, F.lit("Yes")), 1).when(F.contains(a, F.lit("No")), -1)
             .otherwise(0))


def read_votes(raw: DataFrame, item: str = "tweet_id", worker: str = "worker_id",
               answer: str = "answer_text", pos: str = "pos") -> DataFrame:
    """Answer texts -> long votes (item_id, worker_id, answer, pos).

    The long table is the canonical form; ``answers_per_item`` builds the
    reference's per-item list when it is wanted for display.
    """
    return raw.select(F.col(item).alias("item_id"), F.col(worker).alias("worker_id"),
                      answer_code(answer).alias("answer"), F.col(pos).alias("pos"))


def answers_per_item(votes: DataFrame) -> DataFrame:
    """Per-item answer list in arrival order (a task carries a fixed, small
    number of assignments, so each list is bounded by task design)."""
    arr = F.array_sort(F.collect_list(F.struct("pos", "answer", "worker_id")))
    return votes.groupBy("item_id").agg(
        F.transform(arr, lambda s: F.struct(s["answer"].alias("answer"),
                                            s["worker_id"].alias("worker_id"))).alias("answers"))
