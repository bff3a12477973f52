"""Findings of round 4: what a query's time, disk and memory grow with."""

import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import functions as F

from tagtriage.operators import classifiers as cf
from tagtriage.operators import weak


@pytest.fixture
def scored_with(monkeypatch):
    """The coefficients of every regression that scores rows."""
    seen, plain = [], LogisticRegressionModel._transform
    monkeypatch.setattr(LogisticRegressionModel, "_transform",
                        lambda self, df: (seen.append(self.coefficientMatrix), plain(self, df))[1])
    return seen


def test_trust_model_scores_from_dense_weights(spark, scored_with):
    # a few workers: Spark would keep 2^18 x 3 coefficients as a sparse list, walked for every item
    votes = spark.createDataFrame([(i, f"w{(i + k) % 5}", (1, 0, -1)[(i + k) % 3 if k else i % 3], 10 * i + k)
                                   for i in range(60) for k in range(3)],
                                  "item_id long, worker_id string, answer int, pos long")
    gold = votes.where("pos % 10 = 0").select("item_id", F.col("answer").alias("avg_answer"))
    got = {r.item_id: r.ann_label for r in weak.trust_labels(votes, gold, votes).collect()}
    assert len(got) == 60 and set(got.values()) <= {-1, 0, 1}
    assert scored_with and all(isinstance(m, DenseMatrix) for m in scored_with)


def test_text_models_score_from_dense_weights(spark, scored_with):
    rows = [(i, i % 2, "good words here" if i % 2 else "other text there", "writes well" if i % 2 else "writes ill") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, processed_fulltext string, user_description string")
    out = cf.score_profile(cf.score_text(df, *cf.fit_text(df)), *cf.fit_profile(df)).collect()
    assert all((r.txt_label > 0.5) == (r.ud_label > 0.5) == (r.label == 1) for r in out)
    assert len(scored_with) == 2 and all(isinstance(m, DenseMatrix) for m in scored_with)


def test_dense_weights_keep_scores_and_params(spark):
    df = cf.slot_counts(spark.createDataFrame([(i, i % 3, f"word{i % 3} and word{i % 7}") for i in range(60)],
                                              "id long, label int, t string"), "t", "features")
    for rows in (df, df.where("label < 2")):  # three classes and two
        sparse = LogisticRegression(regParam=0.01, probabilityCol="p", predictionCol="y", maxIter=5).fit(rows)
        dense = cf.dense_weights(sparse)
        assert not isinstance(sparse.coefficientMatrix, DenseMatrix) and isinstance(dense.coefficientMatrix, DenseMatrix)
        assert [(r.p, r.y) for r in sparse.transform(df).collect()] == [(r.p, r.y) for r in dense.transform(df).collect()]


def test_denoise_votes_before_the_join(spark):
    """Texts don't move: the join that drops the validation ids sees votes."""
    train = spark.createDataFrame([(1, "my #iphone"), (2, "#Food"), (3, "plain"), (None, "#apple")], "id long, fulltext string")
    val = spark.createDataFrame([(2, 1)], "id long, label int")
    votes = spark.createDataFrame([(i, f"w{k}", 1 if (i + k) % 2 else -1, 10 * i + k) for i in (1, 2, 3) for k in range(3)],
                                  "item_id long, worker_id string, answer int, pos long")
    seen, plain = [], weak.apply_lfs

    def spied(df, *a):
        seen.append(df)
        return plain(df, *a)

    weak.apply_lfs = spied
    try:
        out = {(r.id, r.source) for r in weak.denoise(train, votes, val, votes.where("item_id = 2")).collect()}
    finally:
        weak.apply_lfs = plain
    assert out == {(1, "label_model"), (3, "label_model"), (None, "label_model"), (2, "validation")}
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


TOKENS = [(1, ["a", "b", "c", "a", "b"]), (1, ["b", "c"]), (None, ["x", None, "a", "b", None]), (2, [None, "x"]), (3, []), (4, None),
          (5, ["a", "b", "b", "c", "a"])]


def test_phrases_merge_in_place(spark, monkeypatch):
    from tagtriage.operators import textops
    df = spark.createDataFrame(TOKENS, "id long, t array<string>")
    ph = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), (None, "x"), ("x", None)], "a string, b string")
    out = textops.apply_phrases(df, "t", ph)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # neither texts nor pairs move
    rows = lambda d: sorted(((r["id"], r["t"]) for r in d.collect()), key=str)
    want = sorted([(1, ["a_b", "c", "a_b"]), (1, ["b_c"]), (None, ["x", "a_b"]), (2, [None, "x"]), (3, []), (4, []),
                   (5, ["a_b", "b_c", "a"])], key=str)
    assert rows(out) == want
    monkeypatch.setattr(textops, "MOST_HELD", 1)  # more phrases than that: by joins
    assert rows(textops.apply_phrases(df, "t", ph)) == want


def test_phrases_are_named_by_both_hashes():
    import numpy as np
    from tagtriage.operators import textops
    known = np.array([3, 5, 5, 9]), np.array([1, 2, 7, 4])
    x, y = np.array([5, 5, 5, 3, 4, 9, 10]), np.array([7, 2, 3, 1, 1, 4, 4])
    assert textops._is_known(known, x, y).tolist() == [True, True, False, True, False, True, False]
    assert not textops._is_known((np.array([], np.int64),) * 2, x, y).any()


def test_pairs_that_cannot_score_are_not_stored(spark, monkeypatch):
    from tagtriage.operators import textops
    rows = [(i, ["new", "york", f"w{i}", f"v{i}"]) for i in range(8)] + [(8, None), (9, ["alone"]), (10, [None, "alone"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    kept, plain = [], textops.stored
    monkeypatch.setattr(textops, "stored", lambda d, **k: (kept.append(plain(d, **k)), kept[-1])[1])
    # words: new, york, w0-7, v0-7, alone; pairs: new york, york w*, w* v*; a pair with a null in front counts nowhere
    got = [(r["a"], r["b"], r["n_ab"], r["score"]) for r in textops.phrases(df, "t", 5, 0.5).collect()]
    assert got == [("new", "york", 8, (8 - 5) * 36 / 64)]
    assert kept[0].where("kept AND b IS NOT NULL").count() == 1 and kept[0].where("NOT kept").count() == 1
    assert textops.phrases(df, "t", 5, -1.0).count() == 1 + sum((1 - 5) * 36 / (8 * 1) > -1 for _ in range(8)) + sum((1 - 5) * 36 > -1 for _ in range(8))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_stored_frees_its_shuffle(spark):
    from tagtriage.session import stored
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    one, two = stored(df, free=True), stored(df)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == sorted(map(tuple, df.collect()))


def test_the_widest_kept_distance_settles_few_rows(spark, monkeypatch):
    import numpy as np
    from tagtriage.operators import selection as sel
    monkeypatch.setattr(sel, "PAIR_BLOCK", 16)
    monkeypatch.setattr(sel, "PROBE", 256, raising=False)
    rng = np.random.default_rng(5)
    X = np.concatenate([(Y := rng.normal(size=(1500, 16))) / np.linalg.norm(Y, axis=1, keepdims=True), np.ones((20, 16)) / 4])
    ids = np.arange(len(X)) % (len(X) - 3)  # three ids come twice
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, X)], "id long, features array<double>").cache()
    settled, plain = [], sel._nearest

    def spied(base, id_col, metric, n, rows=None):
        settled.append(rows.count())
        return plain(base, id_col, metric, n, rows)

    want = plain(df, "id", "euclidean", 5).agg(F.max("d")).first()[0]
    monkeypatch.setattr(sel, "_nearest", spied)
    assert sel._widest_kept(df, "id", 5) == pytest.approx(want, rel=1e-9)
    assert sum(settled) < len(X) / 10, settled  # each of them meets the whole table
    few = df.where("id < 4")  # fewer others than neighbours asked for
    assert sel._widest_kept(few, "id", 5) == pytest.approx(plain(few, "id", "euclidean", 5).agg(F.max("d")).first()[0])
    assert sel._widest_kept(df.where("id = 7"), "id", 5) == 0.0
