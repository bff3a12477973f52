"""Detectors, stacking and the self-training loop: properties on sf0.001."""

from pyspark.sql import functions as F

from tagtriage.operators import stacking as stk
from tagtriage.operators.sampling import split
from tagtriage.plans import q_ml

from core_data import SMALL

SETTINGS = stk.Settings(rf_trees=5, meta_rounds=5, folds=2, parallelism=2)


def _split(spark):
    # sf0.001 spans under two days, so split the labelled rows by a seeded hash
    tr, te = split(q_ml.labelled(spark, SMALL), 0.7, seed=1)
    assert te.count() > 0
    return tr, te


def test_base_scores_are_probabilities(spark):
    tr, te = _split(spark)
    det = stk.fit_detectors(tr, SETTINGS)
    sc = stk.base_scores(te, det)
    for c in ("bl_label", "wl_label", "rf_label", "ud_label", "txt_label"):
        r = sc.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).first()
        assert r["n"] == te.count()
        assert 0.0 <= r["lo"] and r["hi"] <= 1.0


def test_stacking_override_and_coverage(spark):
    tr, te = _split(spark)
    det = stk.fit_stacking(tr, SETTINGS)
    ann = stk.annotate(te, det, "stacking")
    assert ann.count() == te.count()
    # the white list wins over everything, the black list over the model
    assert ann.filter((F.col("wl_label") == 0) & (F.col("label_prob") != 0)).count() == 0
    assert ann.filter((F.col("bl_label") == 1) & (F.col("wl_label") != 0)
                      & (F.col("label_prob") != 1)).count() == 0
    w = stk.learner_weights(det, "d0").collect()
    assert len(w) == 3 and abs(sum(r["weight"] for r in w) - 1.0) < 1e-6
