"""Queries: cleaning, projection, filters (B1-B18) and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.operators import cleaning as cl
from tagtriage.operators import sampling as sp
from tagtriage.operators.ensemble import confident
from tagtriage.plans import fixtures as fx
from tagtriage.plans.util import with_ctes
from tagtriage.sources.tables import table

Q = {}


def _docs(spark, d):
    return table(spark, d, "documents")


# ------------------------------------------------------------------ B
Q["B1_strict_unique"] = (
    lambda s, d: cl.strict_unique(_docs(s, d).select("text", "doc_id", "lang", "n_chars"), "text")
                   .select("doc_id", "lang", "n_chars"),
    """SELECT doc_id, lang, n_chars FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING COUNT(*) = 1)""")

Q["B2_exclude_ids"] = (
    lambda s, d: cl.exclude_ids(_docs(s, d), [0, 5, 7], "doc_id").select("doc_id", "n_chars"),
    "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (0, 5, 7)")

RAW = with_ctes(fx.RAW_MESSAGES_SQL)

Q["B3_drop_retweets"] = (
    lambda s, d: cl.drop_retweets(fx.raw_messages(s, d)).select("id"),
    RAW + "SELECT id FROM raw_messages WHERE retweeted_status.id IS NULL")

Q["B4_drop_replies"] = (
    lambda s, d: cl.drop_replies(fx.raw_messages(s, d)).select("id"),
    RAW + "SELECT id FROM raw_messages WHERE in_reply_to_status_id IS NULL")

Q["B5_full_text"] = (
    lambda s, d: fx.raw_messages(s, d).select("id", cl.full_text().alias("fulltext")),
    RAW + """SELECT id, CASE WHEN NOT truncated THEN text ELSE extended_tweet.full_text END
AS fulltext FROM raw_messages""")

TAGS_SQL = """coalesce(list_transform(CASE WHEN truncated THEN extended_tweet.entities.hashtags
  ELSE entities.hashtags END, lambda h: h.text), [])"""
URLS_SQL = """coalesce(list_transform(CASE WHEN truncated THEN extended_tweet.entities.urls
  ELSE entities.urls END, lambda u: u.url), [])"""
TS_SQL = "strptime(replace(substr({c}, 5), '+0000 ', ''), '%b %d %H:%M:%S %Y')"

Q["B6_B8_hashtags_urls"] = (
    lambda s, d: fx.raw_messages(s, d).select(
        "id", cl.hashtag_texts().alias("hashtags"), cl.urls().alias("urls"),
        cl.hashtag_count(cl.hashtag_texts()).alias("number_of_hashtags")),
    RAW + f"""SELECT id, {TAGS_SQL} AS hashtags, {URLS_SQL} AS urls,
CAST(len({TAGS_SQL}) AS INTEGER) AS number_of_hashtags FROM raw_messages""")

Q["B9_B10_parse_ts_month"] = (
    lambda s, d: fx.raw_messages(s, d).select(
        "id", cl.parse_ts("created_at").alias("created_at"),
        cl.year_month(cl.parse_ts("created_at")).alias("month")),
    RAW + f"""SELECT id, {TS_SQL.format(c='created_at')} AS created_at,
CAST(year({TS_SQL.format(c='created_at')}) AS VARCHAR) || '-' ||
CAST(month({TS_SQL.format(c='created_at')}) AS VARCHAR) AS month FROM raw_messages""")

CANONICAL_SQL = f"""clean AS (
  SELECT * FROM raw_messages
  WHERE id IN (SELECT id FROM raw_messages GROUP BY id HAVING COUNT(*) = 1)
    AND retweeted_status.id IS NULL AND in_reply_to_status_id IS NULL),
canonical AS (
  SELECT id, "user".id AS user_id, {TS_SQL.format(c='created_at')} AS created_at,
    CASE WHEN NOT truncated THEN text ELSE extended_tweet.full_text END AS fulltext,
    {TAGS_SQL} AS hashtags, {URLS_SQL} AS urls,
    CAST(len({TAGS_SQL}) AS INTEGER) AS number_of_hashtags,
    favorite_count, retweet_count, quote_count,
    "user".verified AS user_verified, "user".friends_count AS user_friends_count,
    "user".followers_count AS user_followers_count,
    {TS_SQL.format(c='"user".created_at')} AS user_created_at,
    "user".description AS user_description, "user".statuses_count AS user_statuses_count,
    CAST(year({TS_SQL.format(c='created_at')}) AS VARCHAR) || '-' ||
    CAST(month({TS_SQL.format(c='created_at')}) AS VARCHAR) AS month
  FROM clean)"""

Q["B18_clean_seed"] = (
    lambda s, d: cl.clean_seed(fx.raw_messages(s, d)),
    with_ctes(fx.RAW_MESSAGES_SQL, CANONICAL_SQL) + "SELECT * FROM canonical")

Q["B11_project_canonical"] = (
    lambda s, d: cl.project_canonical(fx.raw_messages(s, d)).select(
        "id", "user_id", "user_verified", "user_friends_count", "user_description",
        "user_created_at", "favorite_count"),
    RAW + f"""SELECT id, "user".id AS user_id, "user".verified AS user_verified,
"user".friends_count AS user_friends_count, "user".description AS user_description,
{TS_SQL.format(c='"user".created_at')} AS user_created_at, favorite_count FROM raw_messages""")


def _b12(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"),
                                     "o_totalprice")
    c = table(s, d, "customer").select("c_custkey", *[F.col(x).alias(x + "_y") for x in
                                                      ("c_name", "c_acctbal")])
    return cl.drop_suffix(o.join(c, "c_custkey"), "_y")


Q["B12_drop_suffix"] = (_b12, """SELECT o_orderkey, o_custkey AS c_custkey, o_totalprice
FROM orders JOIN customer ON o_custkey = c_custkey""")

Q["B13_word_in_text"] = (
    lambda s, d: cl.word_in_text(_docs(s, d), "Ther", "text").select("doc_id"),
    "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'ther')")

Q["B14_track"] = (
    lambda s, d: cl.track(fx.doc_messages(s, d), "en", ["MeToo", "gr8"]).select("id"),
    with_ctes(fx.DOC_MESSAGES_SQL) + """SELECT id FROM doc_messages WHERE lang = 'en'
AND (contains(lower(fulltext), 'metoo') OR contains(lower(fulltext), 'gr8'))""")


def _rules(s):
    return s.createDataFrame(
        [("r1", "MeToo"), ("r1", "Stop"), ("r2", "Café"), ("r2", "Ünïcode")],
        "rule string, tag string").withColumn(
        "start", F.lit("2024-01-01").cast("timestamp")).withColumn(
        "end", F.lit("2024-03-01").cast("timestamp"))


Q["B15_rule_scan"] = (
    lambda s, d: cl.rule_scan(cl.clean_seed(fx.raw_messages(s, d)), _rules(s), 5)
                   .select("rule", "month", "id"),
    with_ctes(fx.RAW_MESSAGES_SQL, CANONICAL_SQL, """rules AS (
  SELECT * FROM (VALUES ('r1', 'MeToo'), ('r1', 'Stop'), ('r2', 'Café'), ('r2', 'Ünïcode')) t(rule, tag)),
hits AS (SELECT DISTINCT r.rule, c.id, c.month FROM canonical c, unnest(c.hashtags) AS u(tag), rules r
  WHERE lower(u.tag) = lower(r.tag) AND c.created_at >= TIMESTAMP '2024-01-01'
    AND c.created_at < TIMESTAMP '2024-03-01')""") + """
SELECT rule, month, id FROM (SELECT *, row_number() OVER (PARTITION BY rule, month ORDER BY id) AS rn
FROM hits) WHERE rn <= 5""")

Q["B16_order_by_id"] = (
    lambda s, d: cl.order_by_id(_docs(s, d).select("doc_id", "n_chars"), "doc_id"),
    "SELECT doc_id, n_chars FROM documents ORDER BY doc_id")

Q["B17_distribution"] = (
    lambda s, d: cl.distribution(cl.clean_seed(fx.raw_messages(s, d)), "month"),
    with_ctes(fx.RAW_MESSAGES_SQL, CANONICAL_SQL)
    + "SELECT month, COUNT(DISTINCT id) AS n FROM canonical GROUP BY month")

# ------------------------------------------------------------------ C
U = sp.uniform_sql


def _c1(s, d):
    return sp.weighted_sample(_docs(s, d).select("doc_id", "lang"), 100, "lang", seed=7,
                              key="doc_id", hash="lcg")


Q["C1_weighted_sample"] = (_c1, f"""SELECT doc_id, lang FROM (
  SELECT doc_id, lang, -ln({U('doc_id', 7)}) / COUNT(*) OVER (PARTITION BY lang) AS k FROM documents)
ORDER BY k, doc_id LIMIT 100""")


def _c1p(s, d):
    return sp.weighted_sample(_docs(s, d).select("doc_id", "lang"), 100, "lang", seed=7,
                              key="doc_id", proportional=True, hash="lcg")


Q["C1_weighted_sample_proportional"] = (_c1p, f"""SELECT doc_id, lang FROM documents
ORDER BY -ln({U('doc_id', 7)}), doc_id LIMIT 100""")


def _c2(s, d):
    test, train = sp.holdout(_docs(s, d).select("doc_id", "lang"), 100, 300, "lang", seed=3,
                             key="doc_id", hash="lcg")
    return test.withColumn("part", F.lit("test")).unionByName(
        train.withColumn("part", F.lit("train")))


Q["C2_holdout"] = (_c2, f"""WITH t AS (
  SELECT doc_id, lang FROM (SELECT doc_id, lang,
    -ln({U('doc_id', 3)}) / COUNT(*) OVER (PARTITION BY lang) AS k FROM documents)
  ORDER BY k, doc_id LIMIT 100),
rest AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM t)),
tr AS (SELECT doc_id, lang FROM (SELECT doc_id, lang,
    -ln({U('doc_id', 4)}) / COUNT(*) OVER (PARTITION BY lang) AS k FROM rest)
  ORDER BY k, doc_id LIMIT 300)
SELECT doc_id, lang, 'test' AS part FROM t UNION ALL SELECT doc_id, lang, 'train' AS part FROM tr""")


def _c3(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), "lang")
    return sp.merge_sets(docs.filter(F.col("lang").isin("en", "fr")),
                         docs.filter(F.col("lang").isin("fr", "de")))


Q["C3_merge_sets"] = (_c3, """WITH u AS (
  SELECT doc_id AS id, lang FROM documents WHERE lang IN ('en', 'fr')
  UNION ALL SELECT doc_id AS id, lang FROM documents WHERE lang IN ('fr', 'de'))
SELECT id, lang FROM u WHERE id IN (SELECT id FROM u GROUP BY id HAVING COUNT(*) = 1)""")

Q["C4_exclude_in"] = (
    lambda s, d: sp.exclude_in(_docs(s, d).select("doc_id", "lang"),
                               table(s, d, "labels"), "doc_id"),
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")

Q["C5_append"] = (
    lambda s, d: sp.append(fx.order_messages(s, d).select("id", "user_id", "label"),
                           fx.doc_messages(s, d).select("id", "user_id", "lang")),
    with_ctes(fx.ORDER_MESSAGES_SQL, fx.DOC_MESSAGES_SQL) + """
SELECT id, user_id, label, NULL::VARCHAR AS lang FROM order_messages
UNION ALL SELECT id, user_id, NULL::INTEGER AS label, lang FROM doc_messages""")

Q["C6_random_head"] = (
    lambda s, d: sp.random_head(_docs(s, d).select("doc_id", "source"), 50, seed=11,
                                key="doc_id", hash="lcg"),
    f"SELECT doc_id, source FROM documents ORDER BY {U('doc_id', 11)}, doc_id LIMIT 50")


def _c7(s, d):
    a, b = sp.split(_docs(s, d).select("doc_id"), 0.5, seed=5, key="doc_id", hash="lcg")
    return a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))


Q["C7_split"] = (_c7, f"""SELECT doc_id, CASE WHEN {U('doc_id', 5)} < 0.5 THEN 0 ELSE 1 END AS part
FROM documents""")

Q["C8_kfold_contiguous"] = (
    lambda s, d: sp.kfold(_docs(s, d).select("doc_id"), 4, key="doc_id"),
    "SELECT doc_id, CAST(ntile(4) OVER (ORDER BY doc_id) AS INTEGER) AS fold FROM documents")

Q["C8_kfold_shuffled"] = (
    lambda s, d: sp.kfold(_docs(s, d).select("doc_id"), 5, mode="shuffled", seed=2,
                          key="doc_id", hash="lcg"),
    f"SELECT doc_id, CAST(floor({U('doc_id', 2)} * 5) + 1 AS INTEGER) AS fold FROM documents")

PROB = "(n_chars % 100) / 100.0"


def _scored_docs(s, d):
    return _docs(s, d).select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("label_prob"))


Q["C9_confident"] = (
    lambda s, d: confident(_scored_docs(s, d)),
    f"""SELECT doc_id, {PROB} AS label_prob, CASE WHEN {PROB} >= 0.7 THEN 1 ELSE 0 END AS label
FROM documents WHERE {PROB} >= 0.7 OR {PROB} <= 0.3""")


def _c10(s, d):
    c = confident(_scored_docs(s, d))
    return sp.balance(c.filter("label = 1"), c.filter("label = 0"), seed=9, key="doc_id",
                      hash="lcg").select("doc_id", "label")


Q["C10_balance"] = (_c10, f"""WITH c AS (
  SELECT doc_id, CASE WHEN {PROB} >= 0.7 THEN 1 ELSE 0 END AS label FROM documents
  WHERE {PROB} >= 0.7 OR {PROB} <= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {U('doc_id', 9)}, doc_id) AS rn,
      (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM c GROUP BY label)) AS m FROM c)
SELECT doc_id, label FROM r WHERE rn <= m""")
