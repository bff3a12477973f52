"""Queries: features (G), baselines (K), classifier rules (E) and ensemble
votes (H) -- the deterministic parts with oracles, models rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtriage.operators import baselines as bs
from tagtriage.operators import classifiers as cf
from tagtriage.operators import ensemble as en
from tagtriage.operators import features as fe
from tagtriage.plans import fixtures as fx
from tagtriage.plans import sqltext as st
from tagtriage.plans.q_eval import S, scores
from tagtriage.operators.sampling import uniform_sql
from tagtriage.plans.util import rounded, with_ctes
from tagtriage.session import cut_lineage
from tagtriage.sources.tables import table

Q = {}


# ------------------------------------------------------------ social fixture
def social(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("c_nationkey").cast("long").alias("user_friends_count"),
        F.col("o_totalprice").alias("user_followers_count"),
        F.col("c_acctbal").alias("retweet_count"),
        F.month("o_orderdate").cast("long").alias("favorite_count"),
        (F.col("c_mktsegment") == "BUILDING").alias("user_verified"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("number_of_hashtags"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))


SOCIAL_SQL = """social AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at,
    CAST(c_nationkey AS BIGINT) AS user_friends_count, o_totalprice AS user_followers_count,
    c_acctbal AS retweet_count, CAST(month(o_orderdate) AS BIGINT) AS favorite_count,
    c_mktsegment = 'BUILDING' AS user_verified,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS number_of_hashtags,
    CAST(o_orderstatus = 'F' AS INTEGER) AS label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

SCALED = fe.SOCIAL_SCALED


def _scaled_sql(src: str, name: str) -> str:
    mm = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in SCALED)
    cols = ", ".join(f"CASE WHEN mx_{c} = mn_{c} THEN CAST({c} AS DOUBLE) ELSE ({c} - mn_{c}) / (mx_{c} - mn_{c}) END AS {c}"
                     for c in SCALED)
    return (f"{name}_mm AS (SELECT {mm} FROM {src}),\n{name} AS (SELECT id, label, {cols}, "
            f"CAST(user_verified AS DOUBLE) AS user_verified, CAST(number_of_hashtags AS DOUBLE) "
            f"AS number_of_hashtags FROM {src}, {name}_mm)")


def _g1(s, d):
    return rounded(fe.social_features(social(s, d), keep=["id"]))


Q["G1_social_features"] = (_g1, with_ctes(SOCIAL_SQL, _scaled_sql("social", "sc")) +
                           "SELECT id, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in SCALED) +
                           ", user_verified, number_of_hashtags FROM sc")

Q["G2_label_column"] = (lambda s, d: social(s, d).select("id", "label"),
                        with_ctes(SOCIAL_SQL) + "SELECT id, label FROM social")


def _docs_text(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


TC_SQL = f"""tc AS (SELECT id, term, CAST(COUNT(*) AS DOUBLE) AS tf FROM (
  SELECT doc_id AS id, unnest({st.word_tokens('text')}) AS term FROM documents) GROUP BY id, term)"""

Q["G3_term_counts"] = (lambda s, d: fe.term_counts(_docs_text(s, d), "text"),
                       with_ctes(TC_SQL) + "SELECT id, term, tf FROM tc")

Q["G4_tf_vectors"] = (lambda s, d: rounded(fe.tf_vectors(fe.term_counts(_docs_text(s, d), "text", by_doc=True))),
                      with_ctes(TC_SQL) + """, nrm AS (SELECT id, sqrt(SUM(tf * tf)) AS nrm FROM tc GROUP BY id)
SELECT id, term, ROUND(tf / nrm, 6) AS value FROM tc JOIN nrm USING (id)""")


def _g5(s, d, mf=None):
    docs = _docs_text(s, d)
    return rounded(fe.tfidf(fe.term_counts(docs, "text", packed=True), n_docs=docs.count(), max_features=mf).long())


def _tfidf_sql(mf=None):
    top = ""
    src = "tc"
    if mf:
        top = f""", topt AS (SELECT term FROM tc GROUP BY term ORDER BY SUM(tf) DESC, term LIMIT {mf}),
tc2 AS (SELECT * FROM tc WHERE term IN (SELECT term FROM topt))"""
        src = "tc2"
    return with_ctes(TC_SQL) + top + f""", nd AS (SELECT COUNT(*) AS n FROM documents),
idf AS (SELECT term, ln((1.0 + n) / (1.0 + COUNT(*))) + 1.0 AS idf FROM {src}, nd GROUP BY term, n),
tv AS (SELECT id, term, tf * idf AS v FROM {src} JOIN idf USING (term)),
nrm AS (SELECT id, sqrt(SUM(v * v)) AS nrm FROM tv GROUP BY id)"""


Q["G5_tfidf"] = (_g5, _tfidf_sql() + """
SELECT id, term, ROUND(CASE WHEN nrm > 0 THEN v / nrm ELSE 0 END, 6) AS value FROM tv JOIN nrm USING (id)""")
Q["G5_tfidf_max_features"] = (lambda s, d: _g5(s, d, 1000), _tfidf_sql(1000) + """
SELECT id, term, ROUND(CASE WHEN nrm > 0 THEN v / nrm ELSE 0 END, 6) AS value FROM tv JOIN nrm USING (id)""")


def _g6(s, d):
    docs = _docs_text(s, d)
    tv = fe.tfidf(fe.term_counts(docs, "text", packed=True), n_docs=docs.count()).long()
    return rounded(fe.top_terms(tv, 10))


Q["G6_top_terms"] = (_g6, _tfidf_sql() + """
, r AS (SELECT id, term, CASE WHEN nrm > 0 THEN v / nrm ELSE 0 END AS value FROM tv JOIN nrm USING (id))
SELECT id, term, ROUND(value, 6) AS value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY value DESC, term) AS INTEGER) AS rank FROM r)
WHERE rank <= 10""")


# ------------------------------------------------------------------ K
def _lab_docs(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "source")
    lab = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return docs, docs.join(lab, "id")


LAB_SQL = """train AS (SELECT d.doc_id AS id, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

Q["K2_baseline_mode"] = (
    lambda s, d: bs.baseline_mode(_lab_docs(s, d)[1], _lab_docs(s, d)[0].select("id")),
    with_ctes(LAB_SQL) + """SELECT doc_id AS id, (SELECT label FROM train GROUP BY label
ORDER BY COUNT(*) DESC, label LIMIT 1) AS pred FROM documents""")
Q["K3_baseline_min"] = (
    lambda s, d: bs.baseline_min(_lab_docs(s, d)[1], _lab_docs(s, d)[0].select("id")),
    with_ctes(LAB_SQL) + """SELECT doc_id AS id, (SELECT label FROM train GROUP BY label
ORDER BY COUNT(*), label LIMIT 1) AS pred FROM documents""")
Q["K4_baseline_mean"] = (
    lambda s, d: rounded(bs.baseline_mean(_lab_docs(s, d)[1], _lab_docs(s, d)[0].select("id"))),
    with_ctes(LAB_SQL) + "SELECT doc_id AS id, ROUND((SELECT AVG(label) FROM train), 6) AS pred FROM documents")


def _k1(s, d):
    docs, lab = _lab_docs(s, d)
    return bs.baseline_random(lab, docs.select("id"), seed=4, hash="lcg")


Q["K1_baseline_random"] = (_k1, with_ctes(LAB_SQL) + f"""SELECT doc_id AS id,
  (SELECT list_sort(list(DISTINCT label)) FROM train)[CAST(floor({uniform_sql('doc_id', 4)}
    * (SELECT count(DISTINCT label) FROM train)) AS INTEGER) + 1] AS pred FROM documents""")


def _k5(s, d):
    m = fx.doc_messages(s, d).select("id", "source", "fulltext")
    return bs.baseline_topic(m.filter(F.col("source") == "src0"), m.filter(F.col("source") != "src0"),
                             m, "fulltext").select("id", "pred")


Q["K5_baseline_topic"] = (_k5, with_ctes(fx.DOC_MESSAGES_SQL) + f"""
, ptc AS (SELECT pd, term, CAST(COUNT(*) AS DOUBLE) AS tf FROM (
    SELECT CASE WHEN source = 'src0' THEN 0 ELSE 1 END AS pd, unnest({st.word_tokens('fulltext')}) AS term
    FROM doc_messages) GROUP BY pd, term),
idf AS (SELECT term, ln(3.0 / (1.0 + COUNT(*))) + 1.0 AS idf FROM ptc GROUP BY term),
ptv AS (SELECT pd, term, tf * idf AS v FROM ptc JOIN idf USING (term)),
topic_top AS (SELECT term FROM ptv WHERE pd = 0 ORDER BY v DESC, term LIMIT 10),
ttc AS (SELECT id, term, CAST(COUNT(*) AS DOUBLE) AS tf FROM (
    SELECT id, unnest({st.word_tokens('fulltext')}) AS term FROM doc_messages) GROUP BY id, term),
ttv AS (SELECT id, term, tf * idf AS v FROM ttc JOIN idf USING (term)),
tt AS (SELECT id, term FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, term) AS rn FROM ttv)
       WHERE rn <= 10),
hits AS (SELECT id, COUNT(*) AS h FROM tt WHERE term IN (SELECT term FROM topic_top) GROUP BY id)
SELECT m.id, CASE WHEN coalesce(h, 0) >= 5 THEN 0 ELSE 1 END AS pred
FROM doc_messages m LEFT JOIN hits ON m.id = hits.id""")

Q["K6_known_label"] = (
    lambda s, d: bs.known_label(_lab_docs(s, d)[0].select("id"), _lab_docs(s, d)[1]),
    with_ctes(LAB_SQL) + """SELECT d.doc_id AS id, coalesce(t.label, -1) AS known
FROM documents d LEFT JOIN train t ON d.doc_id = t.id""")

# ------------------------------------------------------------------ E (rules)


def _bin(c):
    return F.when(F.col(c) > 0.5, 1.0).otherwise(0.0)


def _e6(s, d):
    sc = scores(s, d).select("id", *[_bin(c).alias(c) for c in ("lr_label", "nb_label", "rf_label")])
    return en.agree_label(sc).select("id", "label")


Q["E6_agree_label"] = (_e6, S + """, b AS (SELECT id, CASE WHEN lr_label > 0.5 THEN 1.0 ELSE 0.0 END AS lr,
  CASE WHEN nb_label > 0.5 THEN 1.0 ELSE 0.0 END AS nb, CASE WHEN rf_label > 0.5 THEN 1.0 ELSE 0.0 END AS rf FROM scores)
SELECT id, CASE WHEN lr = nb AND rf = lr THEN lr END AS label FROM b""")


def _e9(s, d):
    docs = table(s, d, "documents")
    prof = docs.select(F.col("doc_id").alias("id"),
                       F.when(F.col("doc_id") % 10 == 0, F.lit(None)).otherwise(F.col("lang"))
                        .alias("user_description"),
                       (F.col("n_chars") % 100 / 100.0).alias("p"))
    return rounded(cf.null_profile_rule(prof, "user_description", "p").select("id", "ud_label"))


Q["E9_null_profile_rule"] = (_e9, """SELECT doc_id AS id, ROUND(CASE WHEN doc_id % 10 = 0 THEN 1.0
ELSE (n_chars % 100) / 100.0 END, 6) AS ud_label FROM documents""")


def _clustered(s, d):
    docs = table(s, d, "documents")
    lab = table(s, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "label",
                                           (F.col("n_chars") % 13).cast("int").alias("cluster"))


CL_SQL = """cl AS (SELECT d.doc_id AS id, l.toxic AS label, CAST(d.n_chars % 13 AS INTEGER) AS cluster
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sh AS (SELECT cluster, AVG(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END) AS v,
  AVG(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS h FROM cl GROUP BY cluster)"""

Q["E12_cluster_label"] = (lambda s, d: cf.cluster_label(_clustered(s, d)), with_ctes(CL_SQL) + """
SELECT cluster, CASE WHEN v >= 0.6 THEN 0 WHEN h >= 0.6 THEN 1 ELSE -1 END AS cl_label FROM sh""")
Q["E13_cluster_prob"] = (lambda s, d: rounded(cf.cluster_prob(_clustered(s, d))), with_ctes(CL_SQL) + """
SELECT cluster, ROUND(CASE WHEN v >= 0.6 THEN 1 - v WHEN h >= 0.6 THEN h ELSE 0.5 END, 6) AS cl_label FROM sh""")


def _e14(s, d):
    c = _clustered(s, d)
    labels = cf.cluster_label(c).filter(F.col("cl_label") != -1)
    allc = table(s, d, "documents").select(F.col("doc_id").alias("id"),
                                            (F.col("n_chars") % 13).cast("int").alias("cluster"))
    return cf.score_cluster(allc, labels)


Q["E14_score_cluster"] = (_e14, with_ctes(CL_SQL) + """
, lab AS (SELECT cluster, CASE WHEN v >= 0.6 THEN 0 WHEN h >= 0.6 THEN 1 ELSE -1 END AS cl_label FROM sh)
SELECT d.doc_id AS id, CAST(d.n_chars % 13 AS INTEGER) AS cluster, lab.cl_label FROM documents d
JOIN lab ON CAST(d.n_chars % 13 AS INTEGER) = lab.cluster WHERE lab.cl_label <> -1""")


# ------------------------------------------------------------------ E2 GNB
def _split_social(s, d):
    m = social(s, d)
    cut = F.lit(fx.SPLIT_DATE).cast("timestamp")
    return m.filter(F.col("created_at") < cut), m.filter(F.col("created_at") >= cut)


def _e2(s, d):
    train, test = _split_social(s, d)
    params = cf.fit_gnb(fe.social_features(train, keep=["id", "label"]))
    scored = cf.score_gnb(fe.social_features(test, keep=["id"]), params)
    return rounded(scored.select("id", "nb_label"))


def _gnb_sql():
    cols = fe.SOCIAL_SCALED + fe.SOCIAL_PASS
    longf = lambda src: ("SELECT id, label, f.feature, f.x FROM " + src + ", unnest([" + ", ".join(
        f"{{'feature': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in cols) + "]) AS t(f)")
    return with_ctes(
        SOCIAL_SQL,
        f"tr AS (SELECT * FROM social WHERE created_at < TIMESTAMP '{fx.SPLIT_DATE}')",
        f"te AS (SELECT * FROM social WHERE created_at >= TIMESTAMP '{fx.SPLIT_DATE}')",
        _scaled_sql("tr", "str"), _scaled_sql("te", "ste"),
        f"ltr AS ({longf('str')})", f"lte AS ({longf('ste')})",
        "eps AS (SELECT MAX(v) * 1e-9 AS eps FROM (SELECT feature, var_pop(x) AS v FROM ltr GROUP BY feature))",
        "pri AS (SELECT label AS cls, ln(COUNT(*) / (SELECT COUNT(*) FROM str)) AS lp FROM str GROUP BY label)",
        """par AS (SELECT s.cls, s.feature, s.mean, s.v + eps.eps AS var, pri.lp FROM (
  SELECT label AS cls, feature, AVG(x) AS mean, var_pop(x) AS v FROM ltr GROUP BY label, feature) s, eps, pri
  WHERE s.cls = pri.cls)""",
        """jll AS (SELECT lte.id, par.cls, MAX(par.lp) - 0.5 * SUM(ln(2 * pi() * par.var)
  + (lte.x - par.mean) ** 2 / par.var) AS j FROM lte JOIN par ON lte.feature = par.feature GROUP BY lte.id, par.cls)""",
        """agg AS (SELECT id, MAX(j) AS m, MAX(CASE WHEN cls = 1 THEN j END) AS j1 FROM jll GROUP BY id)""",
    ) + """SELECT agg.id, ROUND(coalesce(exp(agg.j1 - agg.m) / SUM(exp(jll.j - agg.m)), 0.0), 6) AS nb_label
FROM agg JOIN jll ON agg.id = jll.id GROUP BY agg.id, agg.j1, agg.m"""


Q["E2_gaussian_nb"] = (_e2, _gnb_sql())

# ------------------------------------------------------------------ H votes
HS = ["rf_label", "ud_label", "txt_label"]
OVR = "CASE WHEN wl_label = 0 THEN 0.0 WHEN bl_label = 1 THEN 1.0 ELSE {x} END"

Q["H3_vote_majority"] = (
    lambda s, d: en.vote_majority(scores(s, d)).select("id", "result"),
    S + "SELECT id, " + OVR.format(x="""CASE WHEN (CASE WHEN rf_label > 0.5 THEN 1 ELSE 0 END)
  + (CASE WHEN ud_label > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN txt_label > 0.5 THEN 1 ELSE 0 END) >= 2
  THEN 1.0 ELSE 0.0 END""") + " AS result FROM scores")

Q["H4_vote_average"] = (
    lambda s, d: rounded(en.vote_average(scores(s, d)).select("id", "result")),
    S + "SELECT id, ROUND(" + OVR.format(x="(rf_label + ud_label + txt_label) / 3") +
    ", 6) AS result FROM scores")

Q["H5_vote_weighted"] = (
    lambda s, d: rounded(en.vote_weighted(scores(s, d)).select("id", "result")),
    S + """SELECT id, ROUND((0.1 * bl_label + 0.1 * wl_label + 0.1 * rf_label + 0.1 * ud_label
  + 0.6 * txt_label) / 5, 6) AS result FROM scores""")


def _h6(s, d):
    sc = scores(s, d).withColumn("txt_label", _bin("txt_label"))
    return rounded(en.vote_soft(sc).select("id", "label_prob", "label"))


Q["H6_vote_soft"] = (_h6, S + """, t AS (SELECT *, (2 * lr_label + rf_label + nb_label + ud_label + cl_label
  + CASE WHEN txt_label > 0.5 THEN 1.0 ELSE 0.0 END) / 7 AS p FROM scores)
SELECT id, ROUND(p, 6) AS label_prob, CAST(""" + OVR.format(
    x="CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END") + " AS INTEGER) AS label FROM t")

Q["H16_binarise"] = (
    lambda s, d: en.binarise(scores(s, d)).select("id", "bl_label", "wl_label", *HS),
    S + """SELECT id, CASE WHEN bl_label < 1 THEN 0.0 ELSE 1.0 END AS bl_label,
  CASE WHEN wl_label > 0 THEN 1.0 ELSE 0.0 END AS wl_label,
  CASE WHEN rf_label > 0.5 THEN 1.0 ELSE 0.0 END AS rf_label,
  CASE WHEN ud_label > 0.5 THEN 1.0 ELSE 0.0 END AS ud_label,
  CASE WHEN txt_label > 0.5 THEN 1.0 ELSE 0.0 END AS txt_label FROM scores""")


# ------------------------------------------------------------------ M22: naive Bayes, 20 seeds, all sizes at once
CURVE_SIZES, CURVE_SEEDS = [10, 20, 50, 100, 200, 500, 1000, 2000], range(1, 21)


def _m22_nb(s, d):
    from tagtriage.operators import curves
    train, test = (fe.social_features(m, keep=["id", "label"]) for m in _split_social(s, d))
    train = cut_lineage(train)
    picks = curves.random_orders(train, CURVE_SEEDS, max(CURVE_SIZES), hash="lcg")
    return rounded(curves.nb_learning_curve(train, test, picks, CURVE_SIZES, cf.SOCIAL_COLS))


def _m22_nb_sql():
    cols = fe.SOCIAL_SCALED + fe.SOCIAL_PASS
    longf = lambda src: ("SELECT id, label, f.feature, f.x FROM " + src + ", unnest([" + ", ".join(
        f"{{'feature': '{c}', 'x': CAST({c} AS DOUBLE)}}" for c in cols) + "]) AS t(f)")
    picks = " UNION ALL ".join(
        f"SELECT * FROM (SELECT {k} AS seed, id, row_number() OVER (ORDER BY {uniform_sql('id', k)}, id) AS rank FROM str) WHERE rank <= {max(CURVE_SIZES)}"
        for k in CURVE_SEEDS)
    return with_ctes(
        SOCIAL_SQL,
        f"tr AS (SELECT * FROM social WHERE created_at < TIMESTAMP '{fx.SPLIT_DATE}')",
        f"te AS (SELECT * FROM social WHERE created_at >= TIMESTAMP '{fx.SPLIT_DATE}')",
        _scaled_sql("tr", "str"), _scaled_sql("te", "ste"),
        f"ltr AS ({longf('str')})", f"lte AS ({longf('ste')})", f"picks AS ({picks})",
        f"sized AS (SELECT seed, size, id FROM picks, (SELECT unnest({CURVE_SIZES}) AS size) WHERE rank <= size)",
        """eps AS (SELECT seed, size, max(v) * 1e-9 AS eps FROM (
  SELECT seed, size, feature, var_pop(x) AS v FROM sized JOIN ltr USING (id) GROUP BY ALL) GROUP BY ALL)""",
        """par AS (SELECT seed, size, label AS cls, feature, avg(x) AS mean, var_pop(x) + any_value(eps) AS var, count(*) AS n
  FROM sized JOIN ltr USING (id) JOIN eps USING (seed, size) GROUP BY ALL)""",
        "pri AS (SELECT DISTINCT seed, size, cls, ln(n / sum(n) OVER (PARTITION BY seed, size, feature)) AS lp FROM par)",
        """jll AS (SELECT lte.id, lte.label, seed, size, cls, sum(-0.5 * (ln(2 * pi() * var) + (x - mean) ** 2 / var)) AS j
  FROM lte JOIN par USING (feature) GROUP BY ALL)""",
        """told AS (SELECT seed, size, jll.id, any_value(label) AS y, max(j + lp) FILTER (cls = 1) AS j1, max(j + lp) FILTER (cls = 0) AS j0
  FROM jll JOIN pri USING (seed, size, cls) GROUP BY ALL)""",
        """hits AS (SELECT seed, size, y, CASE WHEN j1 IS NULL THEN 0 WHEN j0 IS NULL THEN 1 WHEN 1 / (1 + exp(j0 - j1)) > 0.5 THEN 1 ELSE 0 END AS hit
  FROM told)""",
        """f AS (SELECT seed, size, CASE WHEN sum(hit * y) = 0 THEN 0.0 ELSE 2 * sum(hit * y) / (sum(hit) + sum(y)) END AS f1
  FROM hits GROUP BY ALL)""",
    ) + """SELECT 'random' AS method, size, round(avg(f1), 6) AS f1_mean, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max
FROM f GROUP BY size"""


Q["M22_nb_curve"] = (_m22_nb, _m22_nb_sql())


# ------------------------------------------------------------------ E11 / E15: two rounds of long-form k-means
def _rounds(s, d):
    from tagtriage.operators import clusters
    docs = _docs_text(s, d)
    vectors = fe.tfidf(fe.term_counts(docs, "text", packed=True), n_docs=docs.count())
    return clusters.kmeans(vectors, k=13, rounds=2, hash="lcg")


def _kmeans_sql(rounds=2, k=13):
    ctes = [f"""vec AS (SELECT tv.id, term, v / nrm AS x FROM tv JOIN nrm USING (id) WHERE nrm > 0),
drawn AS (SELECT id, row_number() OVER (ORDER BY u, id) - 1 AS cluster FROM (
  SELECT id, {uniform_sql('id', 1)} AS u FROM (SELECT DISTINCT id FROM vec) ORDER BY u, id LIMIT {k})),
c0 AS (SELECT cluster, term, x AS c FROM vec JOIN drawn USING (id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""n{r} AS (SELECT cluster, sum(c * c) AS sq FROM c{r} GROUP BY cluster),
d{r} AS (SELECT id, cluster, sum(x * c) AS dot FROM vec JOIN c{r} USING (term) GROUP BY id, cluster),
all{r} AS (SELECT i.id, n.cluster, round(n.sq - 2 * coalesce(d.dot, 0), 12) AS far
  FROM (SELECT DISTINCT id FROM vec) i CROSS JOIN n{r} n LEFT JOIN d{r} d ON d.id = i.id AND d.cluster = n.cluster),
a{r} AS (SELECT id, arg_min(cluster, (far, cluster)) AS cluster FROM all{r} GROUP BY id)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS (
  SELECT cluster, term, sum(x) / any_value(n) AS c FROM vec JOIN a{r} USING (id)
    JOIN (SELECT cluster, count(*) AS n FROM a{r} GROUP BY cluster) USING (cluster) GROUP BY cluster, term
  UNION ALL SELECT * FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM a{r}))""")
    return _tfidf_sql() + ",\n" + ",\n".join(ctes)


Q["E11_kmeans_rounds"] = (lambda s, d: _rounds(s, d)[1], _kmeans_sql() + "\nSELECT id, cluster FROM a2")


def _e15_rounds(s, d):
    from tagtriage.operators import clusters
    return rounded(clusters.heaviest_terms(_rounds(s, d)[0], 25))


Q["E15_centre_terms"] = (_e15_rounds, _kmeans_sql() + """
SELECT cluster, term, round(c, 6) AS weight, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(c, 12) DESC, term) AS rank FROM c2) WHERE rank <= 25""")
