"""Queries: user lists, list scores, override, P/R/F."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.functions import text as tx
from tagtriage.operators import evaluate as ev
from tagtriage.operators import lists
from tagtriage.operators.ensemble import override
from tagtriage.plans import fixtures as fx
from tagtriage.plans.sqltext import NORMALISE_SCORE_SQL
from tagtriage.plans.util import rounded, with_ctes

Q = {}


def _split(spark, d):
    m = fx.order_messages(spark, d)
    train = m.filter(F.col("created_at") < F.lit(fx.SPLIT_DATE).cast("timestamp"))
    batch = m.filter(F.col("created_at") >= F.lit(fx.SPLIT_DATE).cast("timestamp"))
    return train, batch


SPLIT_SQL = f"""train AS (SELECT * FROM order_messages WHERE created_at < TIMESTAMP '{fx.SPLIT_DATE}'),
batch AS (SELECT * FROM order_messages WHERE created_at >= TIMESTAMP '{fx.SPLIT_DATE}')"""


def f1_user_counts(spark, d):
    return lists.user_counts(fx.order_messages(spark, d), 1)


Q["F1_user_counts"] = (f1_user_counts, with_ctes(fx.ORDER_MESSAGES_SQL) + """
SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 1 GROUP BY user_id""")


def f2_black_list(spark, d):
    return lists.black_list(fx.order_messages(spark, d), 5)


Q["F2_black_list"] = (f2_black_list, with_ctes(fx.ORDER_MESSAGES_SQL) + """
SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 1
GROUP BY user_id HAVING COUNT(*) >= 5""")


def f3_white_list(spark, d):
    return lists.white_list(fx.order_messages(spark, d), 8)


Q["F3_white_list"] = (f3_white_list, with_ctes(fx.ORDER_MESSAGES_SQL) + """
SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 0
GROUP BY user_id HAVING COUNT(*) >= 8""")


def f4_bl_score(spark, d):
    train, batch = _split(spark, d)
    return lists.bl_score(batch, lists.black_list(train, 5)).select("id", "user_id", "bl_label")


BL_SQL = """bl AS (SELECT user_id FROM train WHERE label = 1 GROUP BY user_id HAVING COUNT(*) >= 5),
wl AS (SELECT user_id FROM train WHERE label = 0 GROUP BY user_id HAVING COUNT(*) >= 8),
scored AS (
  SELECT b.id, b.user_id, b.label,
         CASE WHEN bl.user_id IS NOT NULL THEN 1.0 ELSE 0.5 END AS bl_label,
         CASE WHEN wl.user_id IS NOT NULL AND bl.user_id IS NULL THEN 0.0 ELSE 0.5 END AS wl_label
  FROM batch b LEFT JOIN bl ON b.user_id = bl.user_id LEFT JOIN wl ON b.user_id = wl.user_id)"""

Q["F4_bl_score"] = (f4_bl_score, with_ctes(fx.ORDER_MESSAGES_SQL, SPLIT_SQL, BL_SQL) + """
SELECT id, user_id, bl_label FROM scored""")


def _scored_orders(spark, d):
    train, batch = _split(spark, d)
    s = lists.bl_score(batch, lists.black_list(train, 5))
    empty_words = spark.createDataFrame([], "word string")
    s = s.withColumn("processed_fulltext", F.lit(""))
    return lists.wl_score(s, lists.white_list(train, 8), empty_words)


def h2_override(spark, d):
    s = _scored_orders(spark, d)
    return s.select("id", "bl_label", "wl_label",
                    override(F.lit(0.5)).alias("result"))


Q["H2_override"] = (h2_override, with_ctes(fx.ORDER_MESSAGES_SQL, SPLIT_SQL, BL_SQL) + """
SELECT id, bl_label, wl_label,
       CASE WHEN wl_label = 0 THEN 0.0 WHEN bl_label = 1 THEN 1.0 ELSE 0.5 END AS result
FROM scored""")


def minimum_slice(spark, d):
    """Lists from history, score the later batch, override, report P/R/F1."""
    s = _scored_orders(spark, d).withColumn("result", override(F.lit(0.5)))
    return rounded(ev.prf(s, "result", "label").select(
        "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"))


PRF_SQL = """SELECT tp, fp, fn, tn,
  ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  ROUND(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  ROUND(CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy
FROM c"""


def prf_sql(pred: str, label: str, src: str, pos: int = 1) -> str:
    return f"""c AS (SELECT
  CAST(SUM(CASE WHEN ({pred}) = {pos} AND {label} = {pos} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN ({pred}) = {pos} AND {label} <> {pos} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN ({pred}) <> {pos} AND {label} = {pos} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN ({pred}) <> {pos} AND {label} <> {pos} THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src})"""


Q["J1_prf_minimum_slice"] = (minimum_slice, with_ctes(
    fx.ORDER_MESSAGES_SQL, SPLIT_SQL, BL_SQL,
    """res AS (SELECT label, CASE WHEN wl_label = 0 THEN 0.0 WHEN bl_label = 1 THEN 1.0
               ELSE 0.5 END AS result FROM scored)""",
    prf_sql("CASE WHEN result > 0.5 THEN 1 ELSE 0 END", "label", "res")) + PRF_SQL)


def j1_white_prf(spark, d):
    """J1 for the white list: positive class 0, prediction = score >= 0.5."""
    s = _scored_orders(spark, d)
    return rounded(ev.prf(s, "wl_label", "label", pos=0, ge=True).select(
        "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"))


Q["J1_prf_white_list"] = (j1_white_prf, with_ctes(
    fx.ORDER_MESSAGES_SQL, SPLIT_SQL, BL_SQL,
    prf_sql("CASE WHEN wl_label >= 0.5 THEN 1 ELSE 0 END", "label", "scored", pos=0)) + PRF_SQL)


# --------------------------------------------------------- word weights
def _norm_docs(spark, d):
    m = fx.doc_messages(spark, d, with_label=True)
    return m.withColumn("processed_fulltext", tx.normalise("fulltext", "score"))


NORM_DOCS_SQL = f"""norm_docs AS (
  SELECT *, {NORMALISE_SCORE_SQL.format(c='fulltext')} AS processed_fulltext FROM labelled_docs)"""

WEIGHTS_SQL = r"""span AS (SELECT min(CAST(created_at AS DATE)) AS dmin, max(CAST(created_at AS DATE)) AS dmax
         FROM norm_docs WHERE label IN (0, 1)),
toks AS (
  SELECT n.label,
         CASE WHEN s.dmax = s.dmin THEN 1.0
              ELSE 1.0 - date_diff('day', CAST(n.created_at AS DATE), s.dmax) / date_diff('day', s.dmin, s.dmax) END
           + 1e-6 AS w,
         unnest(regexp_extract_all(n.processed_fulltext, '{TOK}', 0)) AS word
  FROM norm_docs n, span s WHERE n.label IN (0, 1)),
agg AS (SELECT word, SUM(w) AS total, SUM(CASE WHEN label = 1 THEN w END) AS hijacked,
               SUM(CASE WHEN label <> 1 THEN w END) AS valid
        FROM toks WHERE length(word) > 1 GROUP BY word),
weights AS (SELECT word, total, CASE WHEN hijacked >= 15 THEN hijacked END AS hijacked,
                   CASE WHEN valid >= 20 THEN valid END AS valid FROM agg WHERE total >= 15)"""


def _tok_sql():
    from tagtriage.functions.fixed import TWEET_TOKEN_RE
    from tagtriage.plans.sqltext import q
    return q(TWEET_TOKEN_RE)


def _weights_sql():
    from tagtriage.functions.fixed import TWEET_TOKEN_RE
    from tagtriage.plans.sqltext import q
    return WEIGHTS_SQL.replace("'{TOK}'", q(TWEET_TOKEN_RE))


def f6_word_weights(spark, d):
    return rounded(lists.word_weights(_norm_docs(spark, d)))


Q["F6_word_weights"] = (f6_word_weights, with_ctes(
    fx.DOC_MESSAGES_SQL, fx.LABELLED_DOCS_SQL, NORM_DOCS_SQL, _weights_sql()) + """
SELECT word, ROUND(total, 6) AS total, ROUND(hijacked, 6) AS hijacked, ROUND(valid, 6) AS valid
FROM weights""")

KINDS_SQL = """kinds AS (
  SELECT word, total AS weight,
         CASE WHEN coalesce(hijacked, 0) / total > coalesce(valid, 0) / total
                   AND coalesce(hijacked, 0) / total >= {t} THEN 'hijacked'
              WHEN coalesce(valid, 0) / total > coalesce(hijacked, 0) / total
                   AND coalesce(valid, 0) / total >= {t} THEN 'valid' END AS kind
  FROM weights)"""


def f7_word_tables(spark, d):
    return rounded(lists.word_table_kinds(lists.word_weights(_norm_docs(spark, d)), 0.6))


Q["F7_word_tables"] = (f7_word_tables, with_ctes(
    fx.DOC_MESSAGES_SQL, fx.LABELLED_DOCS_SQL, NORM_DOCS_SQL, _weights_sql(),
    KINDS_SQL.format(t=0.6)) + """
SELECT word, kind, ROUND(weight, 6) AS weight FROM kinds WHERE kind IS NOT NULL""")


def f8_upsert(spark, d):
    """Word table of the first half of the days, updated by the whole set."""
    docs = _norm_docs(spark, d)
    old = lists.word_tables(lists.word_weights(
        docs.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp"))), 0.6)[0]
    new = lists.word_tables(lists.word_weights(docs), 0.6)[0]
    return rounded(lists.upsert(old, new))


def _weights_sql_named(src: str, name: str) -> str:
    s = _weights_sql().replace("FROM norm_docs", f"FROM {src}")
    for t in ("span", "toks", "agg", "weights"):
        s = s.replace(f"{t} AS (", f"{name}_{t} AS (")
    s = s.replace("FROM toks", f"FROM {name}_toks").replace("FROM agg", f"FROM {name}_agg")
    s = s.replace("n, span s", f"n, {name}_span s")
    return s


Q["F8_upsert"] = (f8_upsert, with_ctes(
    fx.DOC_MESSAGES_SQL, fx.LABELLED_DOCS_SQL, NORM_DOCS_SQL,
    "old_docs AS (SELECT * FROM norm_docs WHERE created_at < TIMESTAMP '2024-01-16')",
    _weights_sql_named("old_docs", "o"), _weights_sql_named("norm_docs", "n"),
    KINDS_SQL.format(t=0.6).replace("kinds AS", "o_kinds AS").replace("FROM weights", "FROM o_weights"),
    KINDS_SQL.format(t=0.6).replace("kinds AS", "n_kinds AS").replace("FROM weights", "FROM n_weights"),
    ) + """
SELECT coalesce(n.word, o.word) AS word, ROUND(coalesce(n.weight, o.weight), 6) AS weight
FROM (SELECT word, weight FROM o_kinds WHERE kind = 'hijacked') o
FULL OUTER JOIN (SELECT word, weight FROM n_kinds WHERE kind = 'hijacked') n ON o.word = n.word""")


def f5_wl_score(spark, d):
    """White-list score on documents: lists from labelled docs, hijacked
    words from F7; lists are small thresholds on 20 sources."""
    docs = _norm_docs(spark, d)
    bl = lists.black_list(docs, 5)
    wl = lists.white_list(docs, 8)
    words = lists.word_tables(lists.word_weights(docs), 0.6)[0]
    s = lists.bl_score(docs, bl)
    return lists.wl_score(s, wl, words).select("id", "bl_label", "wl_label")


Q["F5_wl_score"] = (f5_wl_score, with_ctes(
    fx.DOC_MESSAGES_SQL, fx.LABELLED_DOCS_SQL, NORM_DOCS_SQL, _weights_sql(),
    KINDS_SQL.format(t=0.6),
    """bl AS (SELECT user_id FROM norm_docs WHERE label = 1 GROUP BY user_id HAVING COUNT(*) >= 5),
wl AS (SELECT user_id FROM norm_docs WHERE label = 0 GROUP BY user_id HAVING COUNT(*) >= 8),
bad AS (SELECT DISTINCT id FROM (
  SELECT id, unnest(regexp_extract_all(processed_fulltext, '{TOK}', 0)) AS word FROM norm_docs) t
  WHERE word IN (SELECT word FROM kinds WHERE kind = 'hijacked'))""".replace(
        "'{TOK}'", _tok_sql())) + """
SELECT n.id, CASE WHEN bl.user_id IS NOT NULL THEN 1.0 ELSE 0.5 END AS bl_label,
       CASE WHEN wl.user_id IS NOT NULL AND bl.user_id IS NULL AND bad.id IS NULL THEN 0.0
            ELSE 0.5 END AS wl_label
FROM norm_docs n LEFT JOIN bl ON n.user_id = bl.user_id LEFT JOIN wl ON n.user_id = wl.user_id
LEFT JOIN bad ON n.id = bad.id""")
