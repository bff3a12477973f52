"""Queries: evaluation, agreement, crowd votes (J1-J16) and weak
supervision (L1-L12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tagtriage.operators import evaluate as ev
from tagtriage.operators import weak
from tagtriage.plans import fixtures as fx
from tagtriage.session import cut_lineage
from tagtriage.plans.util import rounded, with_ctes
from tagtriage.sources.tables import table

Q = {}

# Base-score fixture: labels.toxic as truth, scores from fixed arithmetic.
SCORE_EXPRS = {
    "rf_label": "(n_chars % 101) / 100.0",
    "ud_label": "((doc_id * 7) % 11) / 10.0",
    "txt_label": "((n_chars + doc_id) % 3) / 2.0",
    "lr_label": "(n_chars % 17) / 16.0",
    "nb_label": "(doc_id % 13) / 12.0",
    "cl_label": "(n_chars % 5) / 4.0",
    "bl_label": "CASE WHEN doc_id % 9 = 0 THEN 1.0 ELSE 0.5 END",
    "wl_label": "CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE 0.5 END",
}


def scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    base = docs.join(lab, "doc_id")
    return base.select(F.col("doc_id").alias("id"), "label",
                       *[F.expr(e).cast("double").alias(k) for k, e in SCORE_EXPRS.items()])


SCORES_SQL = "scores AS (SELECT doc_id AS id, toxic AS label, " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {k}" for k, e in SCORE_EXPRS.items()) + \
    " FROM (SELECT d.doc_id, d.n_chars, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id) b)"
S = with_ctes(SCORES_SQL)
V = with_ctes(fx.VOTES_SQL)

PRF_COLS = ["tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]


def _prf_sql(pred, pos=1, src="scores", group=""):
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}tp, fp, fn, tn,
  ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  ROUND(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  ROUND((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy
FROM (SELECT {g}
  CAST(SUM(CASE WHEN ({pred}) = {pos} AND label = {pos} THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN ({pred}) = {pos} AND label <> {pos} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN ({pred}) <> {pos} AND label = {pos} THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN ({pred}) <> {pos} AND label <> {pos} THEN 1 ELSE 0 END) AS BIGINT) AS tn
FROM {src}{gb})"""


Q["J1_prf_scores"] = (
    lambda s, d: rounded(ev.prf(scores(s, d), "rf_label").select(*PRF_COLS)),
    S + _prf_sql("CASE WHEN rf_label > 0.5 THEN 1 ELSE 0 END"))

Q["J2_roc_auc"] = (
    lambda s, d: rounded(ev.roc_auc(scores(s, d), "rf_label")),
    S + """, sc AS (SELECT rf_label AS score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
  SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scores GROUP BY rf_label),
c AS (SELECT *, coalesce(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM sc)
SELECT ROUND(SUM(pos * (cn + 0.5 * neg)) / (SUM(pos) * SUM(neg)), 6) AS auc FROM c""")

CURVE_SQL = """, sc AS (SELECT rf_label AS score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
  SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scores GROUP BY rf_label),
c AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
  SUM(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
  SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM sc)"""

Q["J3_roc_points"] = (
    lambda s, d: rounded(ev.roc_points(scores(s, d), "rf_label")),
    S + CURVE_SQL + """, k AS (SELECT *, row_number() OVER (ORDER BY score DESC) AS rn,
  lead(pos) OVER (ORDER BY score DESC) AS npos, lead(neg) OVER (ORDER BY score DESC) AS nneg FROM c)
SELECT ROUND(score, 6) AS threshold, ROUND(CASE WHEN N = 0 THEN 0 ELSE cn / N END, 6) AS fpr,
  ROUND(CASE WHEN P = 0 THEN 0 ELSE cp / P END, 6) AS tpr FROM k
WHERE rn = 1 OR npos IS NULL OR npos <> pos OR nneg <> neg
UNION ALL SELECT NULL, 0.0, 0.0""")

Q["J3_roc_points_all"] = (
    lambda s, d: rounded(ev.roc_points(scores(s, d), "rf_label", drop_intermediate=False)),
    S + CURVE_SQL + """
SELECT ROUND(score, 6) AS threshold, ROUND(CASE WHEN N = 0 THEN 0 ELSE cn / N END, 6) AS fpr,
  ROUND(CASE WHEN P = 0 THEN 0 ELSE cp / P END, 6) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0""")

Q["J4_pr_points"] = (
    lambda s, d: rounded(ev.pr_points(scores(s, d), "rf_label")),
    S + CURVE_SQL + """
SELECT ROUND(score, 6) AS threshold, ROUND(cp / (cp + cn), 6) AS precision,
  ROUND(CASE WHEN P = 0 THEN 0 ELSE cp / P END, 6) AS recall FROM c WHERE cp - pos < P
UNION ALL SELECT NULL, 1.0, 0.0""")


def _j5(s, d):
    sc = scores(s, d).withColumn("pred", F.when(F.col("txt_label") > 0.5, 1).otherwise(0))
    return rounded(ev.confusion(sc, "pred"))


Q["J5_confusion"] = (_j5, S + """, p AS (SELECT label, CASE WHEN txt_label > 0.5 THEN 1 ELSE 0 END AS pred FROM scores),
c AS (SELECT CAST(SUM(CASE WHEN pred = 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(SUM(CASE WHEN pred = 1 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(SUM(CASE WHEN pred <> 1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(SUM(CASE WHEN pred <> 1 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM p)
SELECT tp, fp, fn, tn, ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  ROUND(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")

MODELS = ["rf_label", "ud_label", "txt_label"]


def _j6(s, d):
    return rounded(ev.score_models(scores(s, d), MODELS).select("model", *PRF_COLS, "auc"))


Q["J6_score_models"] = (_j6, S + """, long AS (
  SELECT label, 'rf_label' AS model, rf_label AS score FROM scores
  UNION ALL SELECT label, 'ud_label', ud_label FROM scores
  UNION ALL SELECT label, 'txt_label', txt_label FROM scores),
sc AS (SELECT model, score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
  SUM(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM long GROUP BY model, score),
cs AS (SELECT *, coalesce(SUM(neg) OVER (PARTITION BY model ORDER BY score
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cn FROM sc),
auc AS (SELECT model, SUM(pos * (cn + 0.5 * neg)) / (SUM(pos) * SUM(neg)) AS auc FROM cs GROUP BY model),
prf AS (""" + _prf_sql("CASE WHEN score > 0.5 THEN 1 ELSE 0 END", src="long", group="model") + """)
SELECT prf.*, ROUND(auc.auc, 6) AS auc FROM prf JOIN auc USING (model)""")

EC = ["rf_label", "ud_label", "txt_label", "lr_label"]


def _j7(s, d):
    return rounded(ev.error_corr(scores(s, d), EC))


def _j7_sql():
    errs = ", ".join(f"(CASE WHEN {c} >= 0.5 THEN 1.0 ELSE 0.0 END) - label AS {c}" for c in EC)
    parts = []
    for i, a in enumerate(EC):
        for b in EC[i + 1:]:
            parts.append(f"SELECT '{a}' AS model_a, '{b}' AS model_b, ROUND(corr({a}, {b}), 6) AS corr FROM e")
    return S + f", e AS (SELECT {errs} FROM scores)\n" + "\nUNION ALL ".join(parts)


Q["J7_error_corr"] = (_j7, _j7_sql())

AVG_ANSWER_SQL = """aa AS (SELECT item_id, CASE WHEN n_pos = greatest(n_neg, n_zero, n_pos) THEN 1
  WHEN n_neg = greatest(n_neg, n_zero, n_pos) THEN -1 ELSE 0 END AS avg_answer FROM (
  SELECT item_id, SUM(CASE WHEN answer = -1 THEN 1 ELSE 0 END) AS n_neg,
    SUM(CASE WHEN answer = 0 THEN 1 ELSE 0 END) AS n_zero,
    SUM(CASE WHEN answer = 1 THEN 1 ELSE 0 END) AS n_pos FROM votes GROUP BY item_id))"""


def _j8(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    gold = ev.avg_answer(fx.votes(s, d)).withColumnRenamed("item_id", "id")
    return ev.merge_gold(docs, gold)


Q["J8_merge_gold"] = (_j8, with_ctes(fx.VOTES_SQL, AVG_ANSWER_SQL) + """
SELECT d.doc_id AS id, d.lang, CAST(CASE aa.avg_answer WHEN 0 THEN -1 WHEN -1 THEN 1 WHEN 1 THEN 0 END
  AS INTEGER) AS g_label FROM documents d JOIN aa ON d.doc_id = aa.item_id""")

FIRST_TWO_SQL = """ft AS (SELECT item_id, MAX(CASE WHEN rn = 1 THEN answer END) AS a1,
  MAX(CASE WHEN rn = 2 THEN answer END) AS a2 FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM votes)
  GROUP BY item_id HAVING COUNT(*) >= 2)"""

Q["J9_vote_conflicts"] = (
    lambda s, d: ev.vote_conflicts(fx.votes(s, d)),
    with_ctes(fx.VOTES_SQL, FIRST_TWO_SQL) + "SELECT item_id, a1, a2, a1 <> a2 AS conflict FROM ft")


def _j10(s, d):
    clean = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    noisy = (ev.avg_answer(fx.votes(s, d))
               .select(F.col("item_id").alias("id"), weak.change_answer("avg_answer").alias("label")))
    return ev.label_conflicts(clean, noisy)


Q["J10_label_conflicts"] = (_j10, with_ctes(fx.VOTES_SQL, AVG_ANSWER_SQL) + """
, noisy AS (SELECT item_id AS id, CASE avg_answer WHEN 1 THEN 0 WHEN 0 THEN -1 WHEN -1 THEN 1 ELSE -1 END AS n_label FROM aa)
SELECT l.doc_id AS id, l.toxic AS label, n.n_label FROM labels l LEFT JOIN noisy n ON l.doc_id = n.id
WHERE l.toxic IS DISTINCT FROM n.n_label""")

Q["J11_avg_answer"] = (lambda s, d: ev.avg_answer(fx.votes(s, d)),
                       with_ctes(fx.VOTES_SQL, AVG_ANSWER_SQL) + "SELECT item_id, avg_answer FROM aa")

Q["J12_most_frequent"] = (lambda s, d: ev.most_frequent(fx.votes(s, d)), V + """
SELECT item_id, CAST(list_reduce(list((answer + 1) * 100000 + 1 ORDER BY pos),
  lambda acc, x: CASE WHEN acc // 100000 = x // 100000 THEN acc + 1
                      WHEN acc % 100000 = 1 THEN x ELSE acc - 1 END) // 100000 - 1 AS INTEGER) AS answer
FROM votes GROUP BY item_id""")

Q["J13_cohen_kappa"] = (lambda s, d: rounded(ev.cohen_kappa(fx.votes(s, d))),
                        with_ctes(fx.VOTES_SQL, FIRST_TWO_SQL) + """
, m AS (SELECT COUNT(*) AS n, SUM(CASE WHEN a1 = a2 THEN 1 ELSE 0 END) AS agree,
  SUM(CASE WHEN a1 = -1 THEN 1 ELSE 0 END) * SUM(CASE WHEN a2 = -1 THEN 1 ELSE 0 END)
  + SUM(CASE WHEN a1 = 0 THEN 1 ELSE 0 END) * SUM(CASE WHEN a2 = 0 THEN 1 ELSE 0 END)
  + SUM(CASE WHEN a1 = 1 THEN 1 ELSE 0 END) * SUM(CASE WHEN a2 = 1 THEN 1 ELSE 0 END) AS cross_sum FROM ft)
SELECT ROUND(CASE WHEN cross_sum / (n * n) = 1 THEN 0.0
  ELSE (agree / n - cross_sum / (n * n)) / (1 - cross_sum / (n * n)) END, 6) AS kappa FROM m""")

VM_SQL = """vm AS (SELECT item_id, CAST(SUM(CASE WHEN answer = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
  CAST(SUM(CASE WHEN answer = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero,
  CAST(SUM(CASE WHEN answer = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos FROM votes GROUP BY item_id)"""

Q["J14_vote_matrix"] = (lambda s, d: ev.vote_matrix(fx.votes(s, d)),
                        with_ctes(fx.VOTES_SQL, VM_SQL) + "SELECT * FROM vm")

Q["J15_fleiss_kappa"] = (lambda s, d: rounded(ev.fleiss_kappa(fx.votes(s, d))),
                         with_ctes(fx.VOTES_SQL, VM_SQL) + """
, s AS (SELECT COUNT(*) AS N, MIN(n_neg + n_zero + n_pos) AS nmin, MAX(n_neg + n_zero + n_pos) AS nmax,
  SUM(n_neg) AS c0, SUM(n_zero) AS c1, SUM(n_pos) AS c2,
  SUM(n_neg * n_neg + n_zero * n_zero + n_pos * n_pos) AS sq FROM vm)
SELECT nmin = nmax AS equal, ROUND(CASE WHEN nmin = nmax AND nmax > 1 THEN
  ((sq - N * nmax) / (nmax * (nmax - 1.0)) / N - ((c0 / (N * nmax)) ** 2 + (c1 / (N * nmax)) ** 2 + (c2 / (N * nmax)) ** 2))
  / (1 - ((c0 / (N * nmax)) ** 2 + (c1 / (N * nmax)) ** 2 + (c2 / (N * nmax)) ** 2)) END, 6) AS kappa FROM s""")


def _j16(s, d):
    lab = ev.avg_answer(fx.votes(s, d)).select(weak.change_answer("avg_answer").alias("label"))
    return ev.class_counts(lab)


Q["J16_class_counts"] = (_j16, with_ctes(fx.VOTES_SQL, AVG_ANSWER_SQL) + """
, l AS (SELECT CASE avg_answer WHEN 1 THEN 0 WHEN 0 THEN -1 WHEN -1 THEN 1 ELSE -1 END AS label FROM aa)
SELECT COUNT(*) AS total, CAST(SUM(CASE WHEN label = -1 THEN 1 ELSE 0 END) AS BIGINT) AS hard,
  CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hijacked,
  CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM l""")

# ------------------------------------------------------------------ L
RECODE = "CASE answer WHEN 1 THEN 0 WHEN 0 THEN -1 WHEN -1 THEN 1 ELSE -1 END"

Q["L1_annotators"] = (lambda s, d: weak.annotators(fx.votes(s, d), 60), V + """
SELECT worker_id, COUNT(*) AS n_votes FROM votes GROUP BY worker_id HAVING COUNT(*) > 60""")

Q["L1_annotator_summary"] = (
    lambda s, d: weak.annotator_summary(weak.annotators(fx.votes(s, d), 60)), V + """
SELECT COUNT(*) AS n_annotators, MAX(n) AS max_votes, MIN(n) AS min_votes FROM (
  SELECT worker_id, COUNT(*) AS n FROM votes GROUP BY worker_id HAVING COUNT(*) > 60)""")

Q["L2_annotator_label_features"] = (
    lambda s, d: weak.annotator_label_features(fx.votes(s, d)), V + f"""
SELECT DISTINCT item_id, worker_id || '_' || CAST({RECODE} AS VARCHAR) AS feature FROM votes""")

Q["L3_annotator_features"] = (lambda s, d: weak.annotator_features(fx.votes(s, d)),
                              V + "SELECT DISTINCT item_id, worker_id FROM votes")

Q["L4_labels_by_annotator"] = (lambda s, d: weak.labels_by_annotator(fx.votes(s, d)), V + f"""
SELECT worker_id, item_id, arg_max({RECODE}, pos) AS label FROM votes GROUP BY worker_id, item_id""")

Q["L5_change_answer"] = (
    lambda s, d: fx.votes(s, d).select("pos", weak.change_answer("answer").alias("label")),
    V + f"SELECT pos, {RECODE} AS label FROM votes")

Q["L6_vote_shares"] = (lambda s, d: rounded(weak.vote_shares(fx.votes(s, d))), V + f"""
SELECT item_id, ROUND(SUM(CASE WHEN {RECODE} = 1 THEN 1 ELSE 0 END) / 7, 6) AS hijacked_share,
  ROUND(SUM(CASE WHEN {RECODE} = 0 THEN 1 ELSE 0 END) / 7, 6) AS valid_share,
  ROUND(SUM(CASE WHEN {RECODE} NOT IN (0, 1) THEN 1 ELSE 0 END) / 7, 6) AS hard_share
FROM votes GROUP BY item_id""")


def _lmatrix(s, d):
    docs = fx.doc_messages(s, d)
    kw = weak.apply_lfs(docs, weak.keyword_lfs(weak.fixed.ACTIVE_KEYWORD_LFS + ["women"]))
    wk = weak.worker_lfs(fx.votes(s, d), docs)
    return kw.unionByName(wk)


def _kw_sql():
    from tagtriage.functions import fixed
    parts = []
    for n, kws, v in fixed.KEYWORD_LFS:
        if n not in fixed.ACTIVE_KEYWORD_LFS + ["women"]:
            continue
        cond = " OR ".join(f"contains(lower(fulltext), '{k}')" for k in kws)
        parts.append(f"SELECT id AS item_id, 'keyword_{kws[0]}' AS lf, {v} AS vote FROM doc_messages WHERE {cond}")
    return "kw AS (" + " UNION ALL ".join(parts) + ")"


LMATRIX_SQL = [fx.DOC_MESSAGES_SQL, fx.VOTES_SQL, _kw_sql(), f"""wk AS (
  SELECT item_id, 'worker_' || worker_id AS lf, CAST(label AS INTEGER) AS vote FROM (
    SELECT worker_id, item_id, arg_max({RECODE}, pos) AS label FROM votes GROUP BY worker_id, item_id)
  WHERE label <> -1 AND item_id IN (SELECT id FROM doc_messages))""",
               "lm AS (SELECT * FROM kw UNION ALL SELECT * FROM wk)"]

Q["L7_L10_label_matrix"] = (_lmatrix, with_ctes(*LMATRIX_SQL) + "SELECT * FROM lm")


def _l11(s, d):
    docs = fx.doc_messages(s, d)
    return rounded(weak.lf_summary(_lmatrix(s, d), items=docs))


Q["L11_lf_summary"] = (_l11, with_ctes(*LMATRIX_SQL) + """
, pi AS (SELECT item_id, COUNT(*) AS n, SUM(CASE WHEN vote = 0 THEN 1 ELSE 0 END) AS n0,
  SUM(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS n1 FROM lm GROUP BY item_id),
ni AS (SELECT COUNT(*) AS n_items FROM doc_messages)
SELECT lf, list_sort(list(DISTINCT vote)) AS polarity, ROUND(COUNT(*) / MAX(n_items), 6) AS coverage,
  ROUND(SUM(CASE WHEN pi.n > 1 THEN 1 ELSE 0 END) / MAX(n_items), 6) AS overlaps,
  ROUND(SUM(CASE WHEN pi.n - (CASE WHEN vote = 0 THEN n0 WHEN vote = 1 THEN n1 ELSE 1 END) > 0
    THEN 1 ELSE 0 END) / MAX(n_items), 6) AS conflicts
FROM lm JOIN pi USING (item_id), ni GROUP BY lf""")


def _l12(s, d):
    return weak.lf_majority(_lmatrix(s, d), fx.doc_messages(s, d))


Q["L12_lf_majority"] = (_l12, with_ctes(*LMATRIX_SQL) + """
, c AS (SELECT item_id, SUM(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS n1,
  SUM(CASE WHEN vote = 0 THEN 1 ELSE 0 END) AS n0 FROM lm GROUP BY item_id)
SELECT d.id AS item_id, CASE WHEN c.n1 > c.n0 THEN 1 WHEN c.n0 > c.n1 THEN 0 ELSE -1 END AS label
FROM doc_messages d LEFT JOIN c ON d.id = c.item_id""")


def _l13(s, d):
    return rounded(weak.label_moments(_lmatrix(s, d), fx.doc_messages(s, d)))


MOMENTS_SQL = """s AS (SELECT item_id, lf, vote * 2 - 1 AS s FROM lm WHERE vote IN (0, 1)),
two AS (SELECT lf, min(s) < max(s) AS two FROM s GROUP BY lf),
half AS (
  SELECT a.lf AS i, b.lf AS j, count(*) AS n, sum(a.s * b.s) / count(*) AS m FROM s a JOIN s b ON a.item_id = b.item_id AND a.lf < b.lf
  WHERE (SELECT two FROM two WHERE lf = a.lf) OR (SELECT two FROM two WHERE lf = b.lf) GROUP BY a.lf, b.lf),
pairs AS (SELECT * FROM half UNION ALL SELECT j, i, n, m FROM half),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS r FROM pairs) WHERE r <= 10),
squares AS (
  SELECT a.i AS lf, sum(least(a.n, b.n, c.n) * a.m * b.m * c.m) / sum(least(a.n, b.n, c.n) * c.m * c.m) AS square
  FROM top a JOIN top b ON a.i = b.i AND a.j < b.j JOIN pairs c ON c.i = a.j AND c.j = b.j GROUP BY a.i),
signs AS (SELECT i AS lf, CASE WHEN sum(n * m) < 0 THEN -1 ELSE 1 END AS sign FROM pairs GROUP BY i),
acc AS (
  SELECT lf, coalesce(sign, 1) * sqrt(least(greatest(coalesce(CASE WHEN isnan(square) THEN NULL ELSE square END,
    (SELECT sum(n * m) / sum(n) FROM pairs), 0), 0), 0.98 * 0.98)) AS accuracy
  FROM (SELECT DISTINCT lf FROM s) LEFT JOIN squares USING (lf) LEFT JOIN signs USING (lf))"""

Q["L13_label_model"] = (_l13, with_ctes(*LMATRIX_SQL, MOMENTS_SQL) + """
, odds AS (SELECT item_id, round(sum(s * ln((1 + accuracy) / (1 - accuracy))), 9) AS odds FROM s JOIN acc USING (lf) GROUP BY item_id)
SELECT d.id AS item_id, round(1 / (1 + exp(-coalesce(odds, 0))), 6) AS p1, CASE WHEN coalesce(odds, 0) > 0 THEN 1 ELSE 0 END AS label
FROM doc_messages d LEFT JOIN odds ON odds.item_id = d.id""")
Q["L13_lf_accuracies"] = (
    lambda s, d: rounded(weak.lf_accuracies(cut_lineage(_lmatrix(s, d)))),
    with_ctes(*LMATRIX_SQL, MOMENTS_SQL) + "SELECT lf, round(accuracy, 6) + 0 AS accuracy FROM acc")


def _l13_sql(rounds=2):
    """The stated start and so many rounds of EM, unrolled."""
    ctes = ["""c AS (SELECT item_id, SUM(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS n1,
  SUM(CASE WHEN vote = 0 THEN 1 ELSE 0 END) AS n0 FROM lm GROUP BY item_id),
q0 AS (SELECT d.id AS item_id, CASE WHEN c.n1 > c.n0 THEN 0.9 WHEN c.n0 > c.n1 THEN 0.1 ELSE 0.5 END::DOUBLE AS q1
  FROM doc_messages d LEFT JOIN c ON d.id = c.item_id)"""]
    for r in range(1, rounds + 1):
        p = f"q{r - 1}"
        ctes.append(f"""t{r} AS (SELECT lf, vote, sum(q1) AS s1, sum(1 - q1) AS s0 FROM lm JOIN {p} USING (item_id) GROUP BY lf, vote),
w{r} AS (SELECT lf, vote, ln((s1 + 1) / (sum(s1) OVER (PARTITION BY lf) + 2)) AS l1,
  ln((s0 + 1) / (sum(s0) OVER (PARTITION BY lf) + 2)) AS l0 FROM t{r}),
a{r} AS (SELECT item_id, sum(l1) AS a1, sum(l0) AS a0 FROM lm JOIN w{r} USING (lf, vote) GROUP BY item_id),
q{r} AS (SELECT {p}.item_id, 1 / (1 + exp((coalesce(a0, 0) + ln(1 - pi)) - (coalesce(a1, 0) + ln(pi)))) AS q1
  FROM {p} LEFT JOIN a{r} USING (item_id), (SELECT avg(q1) AS pi FROM {p}))""")
    return with_ctes(*LMATRIX_SQL, *ctes) + f"SELECT item_id, round(q1, 6) AS p1 FROM q{rounds}"


Q["L13_two_rounds"] = (
    lambda s, d: rounded(weak.label_model(_lmatrix(s, d), fx.doc_messages(s, d), iters=2).select("item_id", "p1")),
    _l13_sql())


def _n8(s, d):
    """User-defined labelling functions: a Column rule and a pandas UDF
    (the escape hatch), applied with the keyword rules."""
    @pandas_udf("int")
    def long_text(t: pd.Series) -> pd.Series:
        return (t.str.len() > 5000).map({True: 1, False: -1}).astype("int32")

    docs = fx.doc_messages(s, d)
    lfs = weak.keyword_lfs() + [
        ("question_mark", F.when(F.col("fulltext").contains("?"), 0).otherwise(-1)),
        ("long_text", long_text(F.col("fulltext")))]
    return weak.apply_lfs(docs, lfs)


Q["N8_user_defined_lfs"] = (_n8, with_ctes(fx.DOC_MESSAGES_SQL, _kw_sql()) + """
SELECT * FROM kw WHERE lf <> 'keyword_women'
UNION ALL SELECT id, 'question_mark', 0 FROM doc_messages WHERE contains(fulltext, '?')
UNION ALL SELECT id, 'long_text', 1 FROM doc_messages WHERE length(fulltext) > 5000""")
