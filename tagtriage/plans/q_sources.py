"""Queries: sources and sinks (A1-A15). File round trips write data that
Spark derives from the driver tables into the shared scratch folder and read
it back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tagtriage.operators import cleaning as cl
from tagtriage.operators import lists
from tagtriage.plans import fixtures as fx
from tagtriage.plans.q_clean import CANONICAL_SQL
from tagtriage.plans.q_lists import f1_user_counts
from tagtriage.plans.util import with_ctes
from tagtriage.sources import crowd, dicts
from tagtriage.sources import messages as ms
from tagtriage.sources.tables import table

Q = {}


def _a1_a3(s, d):
    raw = fx.raw_messages(s, d)
    base = ms.scratch_dir(s, "a1")
    p1, p2 = os.path.join(base, "en"), os.path.join(base, "other")
    ms.write_messages(raw.filter(F.col("user.verified")), p1)
    ms.write_messages(raw.filter(~F.col("user.verified")), p2)
    return cl.clean_seed(ms.read_messages(s, [p1, p2]))


Q["A1_A3_A7_json_round_trip"] = (_a1_a3, with_ctes(fx.RAW_MESSAGES_SQL, CANONICAL_SQL)
                                 + "SELECT * FROM canonical")


def _a2(s, d):
    raw = fx.raw_messages(s, d)
    line = F.to_json(F.struct(*raw.columns))
    broken = F.when(F.col("retweeted_status").isNotNull(),
                    F.substring(line, 1, F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    path = ms.scratch_dir(s, "a2")
    raw.select(broken.alias("value")).write.text(path)
    return ms.read_raw(s, path, on_error="drop").select("id")


Q["A2_drop_malformed"] = (_a2, "SELECT doc_id AS id FROM documents WHERE lang <> 'de'")


def _a2q(s, d):
    raw = fx.raw_messages(s, d)
    line = F.to_json(F.struct(*raw.columns))
    broken = F.when(F.col("retweeted_status").isNotNull(),
                    F.substring(line, 1, F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    path = ms.scratch_dir(s, "a2q")
    raw.select(broken.alias("value")).write.text(path)
    good, bad = ms.read_raw(s, path, on_error="quarantine")
    return good.select(F.lit("good").alias("kind"), "id").unionByName(
        bad.select(F.lit("bad").alias("kind"), F.lit(None).cast("bigint").alias("id")))


Q["A2_quarantine"] = (_a2q, """SELECT CASE WHEN lang = 'de' THEN 'bad' ELSE 'good' END AS kind,
CASE WHEN lang = 'de' THEN NULL ELSE doc_id END AS id FROM documents""")


def _a4(s, d):
    raw = fx.raw_messages(s, d)
    base = ms.scratch_dir(s, "a4")
    pa, pb = os.path.join(base, "apple"), os.path.join(base, "food")
    ms.write_messages(raw.filter(F.col("user.verified")), pa)
    ms.write_messages(raw.filter(~F.col("user.verified")), pb)
    return ms.read_tagged(s, {pa: "Apple", pb: "Food"}).select("id", "category")


Q["A4_read_tagged"] = (_a4, """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN 'Apple' ELSE 'Food' END
AS category FROM documents""")

Q["A6_parse_json"] = (
    lambda s, d: ms.parse_json_column(table(s, d, "events"), "props", "k int")
                   .select("event_id", F.col("props.k").alias("k")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")


def _a7_csv(s, d):
    m = fx.doc_messages(s, d).select("id", "user_id", "lang", "n_chars")
    path = ms.scratch_dir(s, "a7")
    ms.write_messages(m, path, fmt="csv")
    return s.read.schema("id long, user_id long, lang string, n_chars long").option("header", True).csv(path)


Q["A7_csv_round_trip"] = (_a7_csv, with_ctes(fx.DOC_MESSAGES_SQL)
                          + "SELECT id, user_id, lang, n_chars FROM doc_messages")


def _a8_a10(s, d):
    bl = lists.black_list(fx.order_messages(s, d), 5)
    root = ms.scratch_dir(s, "lists")
    dicts.save_dict(bl, os.path.join(root, "black_list"), version="0001")
    missing = dicts.load_dict(s, os.path.join(root, "nothing_here"))
    got = dicts.load_dict(s, dicts.latest_version(s, os.path.join(root, "black_list")))
    return got.unionByName(missing)


Q["A8_A10_list_round_trip"] = (_a8_a10, with_ctes(fx.ORDER_MESSAGES_SQL) + """
SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 1 GROUP BY user_id HAVING COUNT(*) >= 5""")


def _a9(s, d):
    c = f1_user_counts(s, d)
    path = ms.scratch_dir(s, "a9")
    c.select(F.concat_ws(" ", F.col("user_id").cast("string"), F.col("counts").cast("string"))
             .alias("value")).write.text(path)
    return dicts.load_counts_txt(s, path)


Q["A9_counts_txt"] = (_a9, with_ctes(fx.ORDER_MESSAGES_SQL) + """
SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 1 GROUP BY user_id""")


def _engagement(s, d):
    e = table(s, d, "events")
    return (e.groupBy(F.floor(F.col("event_id") / 5).alias("id"))
             .agg(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).cast("long")
                  .alias("favorite_count"),
                  F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("long")
                  .alias("retweet_count")))


def _a13(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    ok, rej = crowd.attach_engagement(docs, _engagement(s, d))
    return ok.withColumn("rejected", F.lit(False)).unionByName(
        rej.withColumn("favorite_count", F.lit(None).cast("long"))
           .withColumn("retweet_count", F.lit(None).cast("long"))
           .withColumn("rejected", F.lit(True)))


Q["A13_attach_engagement"] = (_a13, """WITH eng AS (SELECT event_id // 5 AS id,
  CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS favorite_count,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS retweet_count
  FROM events GROUP BY 1)
SELECT d.doc_id AS id, d.lang, coalesce(e.favorite_count, 0) AS favorite_count,
  coalesce(e.retweet_count, 0) AS retweet_count, false AS rejected
FROM documents d LEFT JOIN eng e ON d.doc_id = e.id
UNION ALL SELECT doc_id, lang, NULL, NULL, true FROM documents WHERE doc_id NOT IN (SELECT id FROM eng)""")


def _a14(s, d):
    return crowd.export_tasks(cl.clean_seed(fx.raw_messages(s, d)))


Q["A14_export_tasks"] = (_a14, with_ctes(fx.RAW_MESSAGES_SQL, CANONICAL_SQL) + """
SELECT id AS tweet_id, replace('<classification-target> ${text} </classification-target>', '${text}',
  list_reduce(urls, lambda acc, x: replace(acc, x, ' <a href="' || x || '"target="_blank"> ' || x || ' </a> '),
              regexp_replace(fulltext, '[^\\x00-\\x7F]', '', 'g'))) AS question FROM canonical""")


def _answers(s, d):
    e = table(s, d, "events")
    txt = (F.when(F.col("event_type") == "click", "Yes, relevant")
            .when(F.col("event_type") == "error", "No").otherwise("Maybe"))
    return e.select(F.floor(F.col("event_id") / 5).alias("tweet_id"),
                    F.col("user_id").cast("string").alias("worker_id"),
                    txt.alias("answer_text"), F.col("event_id").alias("pos"))


Q["A15_read_votes"] = (lambda s, d: crowd.read_votes(_answers(s, d)), """
SELECT event_id // 5 AS item_id, CAST(user_id AS VARCHAR) AS worker_id,
  CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS answer,
  event_id AS pos FROM events""")


def _a5(s, d):
    m = fx.doc_messages(s, d).select("id", "fulltext", "lang")
    base = ms.scratch_dir(s, "a5")
    named = {"en": "Apple", "fr": "Food", "de": "Game"}
    for lang, cat in named.items():
        m.filter(F.col("lang") == lang).drop("lang").write.json(os.path.join(base, f"{cat}-2019"))
    rest = ~F.coalesce(F.col("lang").isin(*named), F.lit(False))
    m.filter(rest).drop("lang").write.json(os.path.join(base, "IPad-2019"))
    return ms.read_by_prefix(s, base, "id long, fulltext string", level="folder")


Q["A5_read_by_prefix"] = (_a5, with_ctes(fx.DOC_MESSAGES_SQL) + """
SELECT id, fulltext, CASE lang WHEN 'en' THEN 'Apple' WHEN 'fr' THEN 'Food' WHEN 'de' THEN 'Game'
  ELSE 'IPad' END AS category FROM doc_messages""")


def _a11_a12(s, d):
    from tagtriage.operators import classifiers as cf
    from tagtriage.plans.q_ml import _tt
    from tagtriage.sources.models import ModelRegistry, save_model
    from pyspark.ml import PipelineModel
    tr, te = _tt(s, d)
    root = ms.scratch_dir(s, "registry")
    vec, model = cf.fit_profile(tr)
    save_model(PipelineModel(stages=list(vec.stages) + [model]), os.path.join(root, "models", "profile"), version="1")
    dicts.save_dict(lists.black_list(tr, 5), os.path.join(root, "black_list"), version="1")
    reg = ModelRegistry(s, root).reload()
    prof = reg.models["profile"]
    scored = prof.transform(te.filter(F.col("user_description").isNotNull()))
    from pyspark.ml.functions import vector_to_array
    return scored.select("id", F.round(vector_to_array("_p_ud")[1], 6).alias("ud_label"))


Q["A11_A12_model_registry"] = (_a11_a12, None)


def _a12(s, d):
    """What a registry serves after each of three publications (9, 10, and an
    unpublished 11)."""
    from tagtriage.sources.models import ModelRegistry
    orders = fx.order_messages(s, d)
    root = ms.scratch_dir(s, "registry")
    path = os.path.join(root, "black_list")
    reg, out = ModelRegistry(s, root), None
    for version, least in (("9", 8), ("10", 5)):
        dicts.save_dict(lists.black_list(orders, least), path, version=version)
        seen = reg.reload().tables["black_list"].withColumn("version", F.lit(version))
        out = seen if out is None else out.unionByName(seen)
    lists.black_list(orders, 1).write.parquet(os.path.join(path, "v=11"))  # not published
    return out.unionByName(reg.reload().tables["black_list"].withColumn("version", F.lit("after 11")))


Q["A12_newest_version"] = (_a12, with_ctes(fx.ORDER_MESSAGES_SQL) + """,
bl AS (SELECT user_id, COUNT(*) AS counts FROM order_messages WHERE label = 1 GROUP BY user_id)
SELECT user_id, counts, '9' AS version FROM bl WHERE counts >= 8
UNION ALL SELECT user_id, counts, '10' FROM bl WHERE counts >= 5
UNION ALL SELECT user_id, counts, 'after 11' FROM bl WHERE counts >= 5""")
