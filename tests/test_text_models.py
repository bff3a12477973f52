"""Text models in hash slots against the same models with a vocabulary."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tagtriage.operators import classifiers as cf
from tagtriage.plans import q_ml

from core_data import SMALL


def test_slots_equal_a_vocabulary(spark):
    df = q_ml.labelled(spark, SMALL).select("id", "label", "processed_fulltext").persist()
    n = df.select(F.explode(F.split(F.lower("processed_fulltext"), r"[^\p{L}\p{N}_]+"))).distinct().count()
    scores = {}
    for name, vec in (("slots", cf.tfidf_model(df, "processed_fulltext", slots=1 << 20)),
                      ("words", cf.tfidf_model(df, "processed_fulltext", max_features=n))):
        lr = LogisticRegression(regParam=0.01, maxIter=200, tol=1e-9, probabilityCol="_p_txt", predictionCol="_y_txt", rawPredictionCol="_r_txt")
        model = lr.fit(vec.transform(df))
        scores[name] = {r.id: r.txt_label for r in cf.score_text(df, vec, model).collect()}
        weights = {r.term: r.weight for r in cf.term_weights(model, vec, df).collect()}
        scores[name + " weights"] = weights
    assert max(abs(scores["slots"][i] - p) for i, p in scores["words"].items()) < 1e-3
    shared = set(scores["slots weights"]) & set(scores["words weights"])
    assert len(shared) >= 0.99 * len(scores["words weights"])
    close = sum(abs(scores["slots weights"][t] - scores["words weights"][t]) < 1e-2 for t in shared)
    assert close >= 0.95 * len(shared)  # the rest share a slot, or are rare and still moving


def test_cluster_terms_are_named(spark):
    df = q_ml.labelled(spark, SMALL).select("id", "label", "processed_fulltext").persist()
    vec, km = cf.fit_clusters(df, k=3)
    rows = cf.cluster_terms(km, vec, df, 5).collect()
    assert {r["rank"] for r in rows} <= set(range(1, 6)) and len({(r.cluster, r.term) for r in rows}) == len(rows) <= 15
    words = {w for r in df.collect() for w in (r.processed_fulltext or "").lower().replace("\n", " ").split()}
    assert any(r.term in words for r in rows)
    assert cf.assign_clusters(df, vec, km).select("cluster").distinct().count() <= 3
