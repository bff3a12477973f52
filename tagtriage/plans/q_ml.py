"""Queries: fitted models and the ensemble loop (E, G7, H, L9, L14, M22).

Model outputs depend on optimiser details, so these are rows-only checks
(properties are tested in tests/); the rule-based steps around the models have
SQL twins over fixed scores. The queries run the operators' own defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.operators import classifiers as cf
from tagtriage.operators import cleaning as cl
from tagtriage.operators import stacking as stk
from tagtriage.operators import weak
from tagtriage.operators.evaluate import avg_answer
from tagtriage.operators.features import social_features
from tagtriage.plans import fixtures as fx
from tagtriage.plans.q_models import social
from tagtriage.operators.sampling import uniform_sql
from tagtriage.plans.util import rounded, with_ctes
from tagtriage.session import cut_lineage
from tagtriage.sources.tables import table

Q = {}
# Share of the labelled rows, oldest first, that models train on.
TRAIN_SHARE = 0.7


def labelled(s, d):
    c = cl.clean_seed(fx.raw_messages(s, d))
    lab = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    # stored: every model stage (vocabulary, idf, optimiser passes) reads it
    return cut_lineage(stk.prepare(c.join(lab, "id")))


def _tt(s, d):
    """The oldest TRAIN_SHARE of the rows to train on, the rest to score."""
    m = labelled(s, d)
    at = F.col("created_at").cast("double")
    cut = m.agg(F.percentile_approx(at, TRAIN_SHARE, 10_000)).first()[0] or 0.0
    return m.filter(at < cut), m.filter(at >= cut)


def _social_split(s, d):
    m = social(s, d)
    cut = F.lit(fx.SPLIT_DATE).cast("timestamp")
    return m.filter(F.col("created_at") < cut), m.filter(F.col("created_at") >= cut)


def _e1(s, d):
    tr, te = _social_split(s, d)
    models = cf.fit_social(social_features(tr, keep=["id", "label"]))
    sc = cf.score_social(social_features(te, keep=["id"]), models)
    return rounded(sc.select("id", "lr_label", "rf_label", "nb_label"))


Q["E1_E5_social_models"] = (_e1, None)


def _e7(s, d):
    tr, te = _tt(s, d)
    vec, model = cf.fit_text(tr)
    return rounded(cf.score_text(te, vec, model, prob=True).select("id", "txt_label"))


Q["E7_text_classifier"] = (_e7, None)


def _e8(s, d):
    tr, te = _tt(s, d)
    vec, model = cf.fit_profile(tr)
    return rounded(cf.score_profile(te, vec, model).select("id", "ud_label"))


Q["E8_E9_profile_classifier"] = (_e8, None)


def _e10(s, d):
    """5-fold accuracy of the profile (user description) classifier,
    trained on rows with a description."""
    m = labelled(s, d).filter(F.col("user_description").isNotNull())

    def fit_score(train, test):
        vec, model = cf.fit_profile(train)
        return cf.score_profile(test, vec, model, prob=False, out="pred")

    return rounded(cf.cv_accuracy(m, fit_score, k=5))


Q["E10_cv_accuracy"] = (_e10, None)


def _e11(s, d):
    m = labelled(s, d)
    vec, km = cf.fit_clusters(m, k=13)
    return cf.assign_clusters(m, vec, km).select("id", "cluster")


Q["E11_kmeans"] = (_e11, None)


def _e15(s, d):
    m = labelled(s, d)
    vec, km = cf.fit_clusters(m, k=13)
    return rounded(cf.cluster_terms(km, vec, m, 25))


Q["E15_cluster_terms"] = (_e15, None)


def _g7(s, d):
    tr, _ = _tt(s, d)
    vec, model = cf.fit_text(tr)
    from tagtriage.operators.features import top_features
    return rounded(top_features(cf.term_weights(model, vec, tr), 10))


Q["G7_top_features"] = (_g7, None)


def _h1(s, d):
    tr, te = _tt(s, d)
    det = stk.fit_detectors(tr)
    return rounded(stk.base_scores(te, det).select("id", "bl_label", "wl_label", *stk.BASE))


Q["H1_base_scores"] = (_h1, None)


def _h8(s, d):
    tr, te = _tt(s, d)
    det = stk.fit_stacking(tr)
    return rounded(stk.annotate(te, det, "stacking").select("id", "label_prob"))


Q["H7_H8_H9_stacking"] = (_h8, None)


def _h10(s, d):
    tr, te = _tt(s, d)
    det = stk.fit_blending(tr)
    return rounded(stk.annotate(te, det, "stacking").select("id", "label_prob"))


Q["H10_blending"] = (_h10, None)


def _h12(s, d):
    tr, te = _tt(s, d)
    return rounded(stk.label_and_score(te, stk.fit_stacking(tr)))


Q["H11_H12_label_and_score"] = (_h12, None)


def _h13(s, d):
    tr, te = _tt(s, d)
    res, weights = stk.self_train(tr, te)
    # one loop gives both: the annotated rows (H13) and each day's weights
    return rounded(res.select("day", F.col("id").cast("string").alias("name"), F.col("label_prob").alias("value"),
                              F.lit("row").alias("kind"))
                   .unionByName(weights.select("day", F.col("learner").alias("name"), F.col("weight").alias("value"),
                                               F.lit("weight").alias("kind"))))


Q["H13_H14_self_train"] = (_h13, None)


def _h15(s, d):
    tr, te = _tt(s, d)
    rows, metrics = stk.repeat_eval(tr, te)
    return rounded(rows.select(F.col("id").cast("string").alias("name"), "mean_meta", "mean_average", "mean_majority",
                               *[F.lit(None).cast("double").alias(c) for c in ("auc", "precision", "recall", "f1")])
                   .unionByName(metrics.select(F.col("model").alias("name"), *[
                       F.lit(None).cast("double").alias(f"mean_{c}") for c in ("meta", "average", "majority")],
                       "auc", "precision", "recall", "f1")))


Q["H15_repeat_eval"] = (_h15, None)


def _fixed_scores(s, d):
    """Base scores by arithmetic on the id: the same in any engine, with ties,
    listed users and all mixes of confident and open rows."""
    m = fx.doc_messages(s, d)
    return m.select("id", "user_id", "created_at", "n_chars", "lang",
                    F.when(F.col("id") % 11 == 0, 1.0).otherwise(0.5).alias("bl_label"),
                    F.when(F.col("id") % 7 == 0, 0.0).otherwise(0.5).alias("wl_label"),
                    ((F.col("id") * 37 % 101) / 100.0).alias("rf_label"),
                    ((F.col("id") * 53 % 97) / 96.0).alias("ud_label"),
                    ((F.col("n_chars") % 89) / 88.0).alias("txt_label"))


FIXED_SCORES_SQL = """fixed AS (
  SELECT id, user_id, created_at, n_chars, lang,
    CASE WHEN id % 11 = 0 THEN 1.0 ELSE 0.5 END AS bl_label, CASE WHEN id % 7 = 0 THEN 0.0 ELSE 0.5 END AS wl_label,
    (id * 37 % 101) / 100.0 AS rf_label, (id * 53 % 97) / 96.0 AS ud_label, (n_chars % 89) / 88.0 AS txt_label
  FROM doc_messages),
voted AS (
  SELECT *, (rf_label + ud_label + txt_label) / 3 AS mean FROM fixed),
scored AS (
  SELECT *, CASE WHEN wl_label = 0 THEN 0.0 WHEN bl_label = 1 THEN 1.0 ELSE mean END AS label_prob FROM voted)"""


def _h13_step(s, d):
    """One step of self-training over fixed scores: vote, override, confident
    rows, balance, append."""
    from tagtriage.operators.ensemble import vote_average
    scores = _fixed_scores(s, d)
    first = F.col("created_at") < F.lit("2024-01-11").cast("timestamp")
    train = scores.filter(first).select("id", "user_id", "lang", (F.col("id") % 2).cast("int").alias("label"))
    batch = scores.filter(~first)
    voted = cut_lineage(vote_average(batch, out="label_prob"))
    return stk.grow(train, batch, voted.select("id", "label_prob"), hash="lcg").select("id", "user_id", "lang", "label")


Q["H13_grow_training"] = (_h13_step, with_ctes(fx.DOC_MESSAGES_SQL, FIXED_SCORES_SQL, f"""sure AS (
  SELECT id, user_id, lang, CASE WHEN label_prob >= 0.7 THEN 1 ELSE 0 END AS label, {uniform_sql('id', 0)} AS u
  FROM scored WHERE created_at >= TIMESTAMP '2024-01-11' AND (label_prob >= 0.7 OR label_prob <= 0.3)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, id) AS rn FROM sure),
least AS (
  SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS m FROM sure)""") + """
SELECT id, user_id, lang, CAST(id % 2 AS INTEGER) AS label FROM fixed WHERE created_at < TIMESTAMP '2024-01-11'
UNION ALL SELECT id, user_id, lang, label FROM ranked, least WHERE rn <= m""")


BOOST_EDGES = [k / 10 for k in range(1, 10)]


def _boost_label(rf, ud, i):
    return F.when(rf + ud / 2 + (i % 3) / 3.0 > 1.1, 1).otherwise(0)


def _h9(s, d):
    """Three rounds of one-cut trees on all rows, scored on the same rows."""
    from tagtriage.operators.boosting import fit_boosted
    m = _fixed_scores(s, d).withColumn("label", _boost_label(F.col("rf_label"), F.col("ud_label"), F.col("id")))
    model = fit_boosted(m, list(stk.BASE), rounds=3, depth=1, subsample=1.0, rate=0.3, edges=[BOOST_EDGES] * 3)
    return rounded(model.transform(m).select("id", "p_meta"))


def _h9_sql(rounds=3, rate=0.3):
    ctes = ["""r0 AS (SELECT id, rf_label, ud_label, txt_label, y, 0.5 * ln(avg(y) OVER () / (1 - avg(y) OVER ())) AS f FROM (
  SELECT *, CASE WHEN rf_label + ud_label / 2 + (id % 3) / 3.0 > 1.1 THEN 1 ELSE 0 END AS y FROM fixed))""",
            f"edges AS (SELECT unnest({BOOST_EDGES}) AS edge)"]
    for k in range(1, rounds + 1):
        ctes.append(f"""x{k} AS (
  SELECT id, (2 * y - 1) * exp(-(2 * y - 1) * f) AS t, unnest([{{'a': 0, 'x': rf_label}}, {{'a': 1, 'x': ud_label}},
    {{'a': 2, 'x': txt_label}}], recursive := true) FROM r{k - 1}),
g{k} AS (
  SELECT a, edge, count(*) FILTER (x <= edge) AS wl, count(*) FILTER (x > edge) AS wr, sum(t) FILTER (x <= edge) AS tl,
    sum(t) FILTER (x > edge) AS tr FROM x{k}, edges GROUP BY a, edge),
b{k} AS (SELECT a, edge FROM g{k} WHERE wl > 0 AND wr > 0 ORDER BY wl * wr / (wl + wr) * pow(tl / wl - tr / wr, 2) DESC, a, edge LIMIT 1),
s{k} AS (SELECT id, t, x > edge AS side FROM x{k} JOIN b{k} USING (a)),
r{k} AS (
  SELECT id, rf_label, ud_label, txt_label, y, f + {rate} * (sum(t) OVER (PARTITION BY side) / sum(abs(t)) OVER (PARTITION BY side)) AS f
  FROM r{k - 1} JOIN s{k} USING (id))""")
    return with_ctes(fx.DOC_MESSAGES_SQL, FIXED_SCORES_SQL, *ctes) + f"SELECT id, round(1 / (1 + exp(-2 * f)), 6) AS p_meta FROM r{rounds}"


Q["H9_boost_rounds"] = (_h9, _h9_sql())


def _h11(s, d):
    """The three votes over fixed scores, one row per document."""
    from tagtriage.operators.ensemble import vote_average, vote_majority, vote_weighted
    sc = vote_weighted(vote_majority(vote_average(_fixed_scores(s, d), out="average"), out="majority"), out="weighted")
    return rounded(sc.select("id", "average", "majority", "weighted"))


Q["H11_votes"] = (_h11, with_ctes(fx.DOC_MESSAGES_SQL, FIXED_SCORES_SQL) + """
SELECT id, round(label_prob, 6) AS average, CASE WHEN wl_label = 0 THEN 0.0 WHEN bl_label = 1 THEN 1.0
    WHEN (rf_label > 0.5)::INT + (ud_label > 0.5)::INT + (txt_label > 0.5)::INT >= 2 THEN 1.0 ELSE 0.0 END AS majority,
  round((0.1 * bl_label + 0.1 * wl_label + 0.1 * rf_label + 0.1 * ud_label + 0.6 * txt_label) / 5, 6) AS weighted
FROM scored""")


def _l9(s, d):
    """Trust model fitted on one seeded half of the items, applied to the
    other half (both halves are used)."""
    from tagtriage.operators.sampling import split
    v = fx.votes(s, d)
    a, b = split(v.select("item_id").distinct(), 0.5, seed=13, key="item_id")
    train_items = v.join(a, "item_id", "left_semi")
    test_items = v.join(b, "item_id", "left_semi")
    return weak.trust_labels(train_items, avg_answer(train_items), test_items)


Q["L9_trust_labels"] = (_l9, None)


def _l14(s, d):
    docs = fx.doc_messages(s, d)
    v = fx.votes(s, d)
    lab = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    val = docs.join(lab, "id").select("id", "label")
    val_votes = v.join(val.select(F.col("id").alias("item_id")), "item_id", "left_semi")
    return weak.denoise(docs, v, val, val_votes)


Q["L14_denoise"] = (_l14, None)


def _m22(s, d):
    """Social-feature Gaussian NB trained on the first n picks of
    feature-based, facility-location and random selection."""
    from tagtriage.operators import selection as sel
    from tagtriage.operators.curves import learning_curve
    tr, te = _tt(s, d)
    cols = cf.SOCIAL_COLS
    trs = social_features(tr, keep=["id", "label"]).persist()
    tes = social_features(te, keep=["id", "label"]).persist()
    feats = trs.select("id", F.array(*[F.col(c).cast("double") for c in cols]).alias("features"))

    def fit_score(a, b):
        params = cf.fit_gnb(a)
        return cf.score_gnb(b, params, out="score")

    picks = {
        "feature_based": sel.select(feats, sel.FeatureBased("sqrt"), 40, strategy="partitioned",
                                    part_rows=500),
        "facility": sel.select(feats, sel.Facility(metric="euclidean"), 40,
                               strategy="partitioned", part_rows=500, check=False),
        "random": [sel.select(feats, sel.FeatureBased(), 40, strategy="random", seed=i)
                   for i in range(3)],
    }
    return rounded(learning_curve(trs, tes, picks, [10, 20, 40], fit_score))


Q["M22_learning_curve"] = (_m22, None)
