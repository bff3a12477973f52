"""Derive operator input shapes from the driver tables, in Spark and in SQL.

Each ``*_sql`` constant is the DuckDB twin of the Spark function above it,
used as a CTE by the oracles. Mappings (see FIXTURES.md):

* order messages: id = o_orderkey, user_id = o_custkey, label = status 'F'
* document messages: id = doc_id, user_id = number in ``source``, day =
  2024-01-01 + doc_id % 30, text = a feature prefix (URL, @name, #tag,
  emoji, slang, CJK) chosen by doc_id % 8, followed by the whole text
* votes: item_id = event_id div 5 (five votes an item), worker_id = user_id, answer from the
  event type, pos = event_id (arrival order)
* raw nested messages: documents as tweets (German rows play retweets,
  Spanish rows play replies, texts longer than 280 chars are truncated
  tweets whose full text sits in ``extended_tweet``)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtriage.sources.tables import table

# ---------------------------------------------------------------- orders
def order_messages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                    F.col("o_orderdate").alias("created_at"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("label"))


ORDER_MESSAGES_SQL = """order_messages AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders)"""

SPLIT_DATE = "2000-01-01"

# ------------------------------------------------------------- documents
_PREFIXES = [
    ("0", "'Read https://news.example.org/p/' || CAST(doc_id AS STRING) || ' now! '"),
    ("1", "'@user' || CAST(doc_id % 37 AS STRING) || ' said: '"),
    ("2", "'#MeToo #Café story: '"),
    ("3", "'LOL 😀🎉 BTW, '"),
    ("4", "'IMHO u r GR8!! '"),
    ("5", "'中文 한국어 #Ünïcode '"),
    ("6", "'Don''t @Me http://t.co/x1 #Stop! '"),
]
PREFIX_SQL = ("CASE CAST(doc_id % 8 AS INTEGER) "
              + " ".join(f"WHEN {k} THEN {v}" for k, v in _PREFIXES) + " ELSE '' END")


def doc_prefix() -> F.Column:
    return F.expr(PREFIX_SQL)


def doc_messages(spark: SparkSession, d: str, with_label: bool = False) -> DataFrame:
    docs = table(spark, d, "documents")
    m = docs.select(
        F.col("doc_id").alias("id"),
        F.substring("source", 4, 100).cast("bigint").alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
         .cast("timestamp").alias("created_at"),
        F.concat(doc_prefix(), F.col("text")).alias("fulltext"),
        "lang", "source", "n_chars")
    if with_label:
        lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"),
                                                F.col("toxic").alias("label"))
        m = m.join(lab, "id", "inner")
    return m


DOC_MESSAGES_SQL = f"""doc_messages AS (
  SELECT doc_id AS id, CAST(substr(source, 4) AS BIGINT) AS user_id,
         CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS created_at,
         ({PREFIX_SQL}) || text AS fulltext, lang, source, n_chars FROM documents)"""
LABELLED_DOCS_SQL = """labelled_docs AS (
  SELECT m.*, l.toxic AS label FROM doc_messages m JOIN labels l ON m.id = l.doc_id)"""

# ----------------------------------------------------------------- votes
def votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    ans = (F.when(F.col("event_type").isin("click", "purchase"), 1)
            .when(F.col("event_type") == "error", -1).otherwise(0))
    return e.select(F.floor(F.col("event_id") / 5).alias("item_id"),
                    F.col("user_id").cast("string").alias("worker_id"),
                    ans.alias("answer"), F.col("event_id").alias("pos"))


VOTES_SQL = """votes AS (
  SELECT event_id // 5 AS item_id, CAST(user_id AS VARCHAR) AS worker_id,
         CASE WHEN event_type IN ('click', 'purchase') THEN 1
              WHEN event_type = 'error' THEN -1 ELSE 0 END AS answer,
         event_id AS pos FROM events)"""

# ----------------------------------------------------- raw nested messages
RAW_TS_SQL = "make_timestamp(CAST((1704067200 + doc_id * 600) AS BIGINT) * 1000000)"


def raw_messages(spark: SparkSession, d: str) -> DataFrame:
    """Nested tweet-shaped rows (the raw feed schema of FIXTURES.md)."""
    docs = table(spark, d, "documents")
    full = F.concat(doc_prefix(), F.col("text"))
    trunc = F.col("n_chars") > 280
    short = F.when(trunc, F.substring_index(full, "\n", 1)).otherwise(full)

    def ents(t):
        return F.struct(
            F.transform(F.regexp_extract_all(t, F.lit(r"#([\p{L}\p{N}_]+)"), 1),
                        lambda x: F.struct(x.alias("text"))).alias("hashtags"),
            F.transform(F.regexp_extract_all(t, F.lit(r"https?://\S+"), 0),
                        lambda x: F.struct(x.alias("url"))).alias("urls"))

    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 600)
    user = F.struct(
        F.substring("source", 4, 100).cast("bigint").alias("id"),
        (F.col("lang") == "en").alias("verified"),
        (F.col("n_chars") % 997).alias("friends_count"),
        F.col("n_chars").alias("followers_count"),
        F.date_format(F.timestamp_seconds(F.lit(1600000000) + F.col("doc_id") * 86400),
                      "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("writes in "), F.col("lang")))
         .alias("description"),
        (F.col("n_chars") % 5000).alias("statuses_count"))
    return docs.select(
        F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.col("doc_id").alias("id"),
        short.alias("text"),
        F.col("lang"),
        trunc.alias("truncated"),
        F.when(F.col("lang") == "es", F.col("doc_id") + 1).alias("in_reply_to_status_id"),
        F.when(F.col("lang") == "de", F.struct((F.col("doc_id") + 1).alias("id")))
         .alias("retweeted_status"),
        (F.col("n_chars") % 13).alias("favorite_count"),
        (F.col("n_chars") % 7).alias("retweet_count"),
        (F.col("n_chars") % 3).alias("quote_count"),
        user.alias("user"),
        ents(short).alias("entities"),
        F.when(trunc, F.struct(full.alias("full_text"), ents(full).alias("entities")))
         .alias("extended_tweet"))


def _ents_sql(t: str) -> str:
    return ("{'hashtags': list_transform(regexp_extract_all(" + t
            + ", '#([\\p{L}\\p{N}_]+)', 1), lambda x: {'text': x}), "
            "'urls': list_transform(regexp_extract_all(" + t
            + ", 'https?://\\S+', 0), lambda x: {'url': x})}")


RAW_MESSAGES_SQL = f"""raw_base AS (
  SELECT *, ({PREFIX_SQL}) || text AS full_t, n_chars > 280 AS trunc FROM documents),
raw_short AS (
  SELECT *, CASE WHEN trunc THEN split_part(full_t, chr(10), 1) ELSE full_t END AS short_t
  FROM raw_base),
raw_messages AS (
  SELECT strftime({RAW_TS_SQL}, '%a %b %d %H:%M:%S +0000 %Y') AS created_at,
         doc_id AS id, short_t AS text, lang, trunc AS truncated,
         CASE WHEN lang = 'es' THEN doc_id + 1 END AS in_reply_to_status_id,
         CASE WHEN lang = 'de' THEN {{'id': doc_id + 1}} END AS retweeted_status,
         n_chars % 13 AS favorite_count, n_chars % 7 AS retweet_count, n_chars % 3 AS quote_count,
         {{'id': CAST(substr(source, 4) AS BIGINT), 'verified': lang = 'en',
          'friends_count': n_chars % 997, 'followers_count': n_chars,
          'created_at': strftime(make_timestamp(CAST((1600000000 + doc_id * 86400) AS BIGINT) * 1000000),
                                 '%a %b %d %H:%M:%S +0000 %Y'),
          'description': CASE WHEN lang <> 'fr' THEN 'writes in ' || lang END,
          'statuses_count': n_chars % 5000}} AS "user",
         {_ents_sql('short_t')} AS entities,
         CASE WHEN trunc THEN {{'full_text': full_t, 'entities': {_ents_sql('full_t')}}} END
           AS extended_tweet
  FROM raw_short)"""
