"""Weak supervision: planted labelling-function accuracies are recovered."""

import random

from pyspark.sql import functions as F

from tagtriage.operators import weak


def test_label_model_recovers_planted_truth(spark):
    rnd = random.Random(7)
    truth = {i: rnd.randint(0, 1) for i in range(400)}
    acc = {"good1": 0.9, "good2": 0.85, "good3": 0.8, "noisy": 0.55}
    rows = []
    for i, y in truth.items():
        for lf, a in acc.items():
            if rnd.random() < 0.8:
                rows.append((i, lf, y if rnd.random() < a else 1 - y))
    L = spark.createDataFrame(rows, "item_id long, lf string, vote int")
    items = spark.createDataFrame([(i,) for i in truth], "id long")
    out = {r["item_id"]: r["label"] for r in weak.label_model(L, items, iters=15).collect()}
    hits = sum(out[i] == y for i, y in truth.items())
    maj = {r["item_id"]: r["label"] for r in weak.lf_majority(L, items).collect()}
    maj_hits = sum(maj[i] == y for i, y in truth.items())
    assert hits / len(truth) > 0.85
    assert hits >= maj_hits


def test_moments_recover_accuracies(spark):
    rnd = random.Random(11)
    acc = {"a": 0.95, "b": 0.85, "c": 0.75, "d": 0.65, "wrong": 0.2}
    rows, truth = [], {}
    for i in range(4000):
        truth[i] = y = rnd.randint(0, 1)
        rows += [(i, lf, y if rnd.random() < p else 1 - y) for lf, p in acc.items() if rnd.random() < 0.6]
        if rnd.random() < (0.4 if y else 0.05):   # knows one class only
            rows.append((i, "word", 1))
    rows += [(9000 + i, "lonely", i % 2) for i in range(10)]
    L = spark.createDataFrame(rows, "item_id long, lf string, vote int")
    got = {r.lf: r.accuracy for r in weak.lf_accuracies(L).collect()}
    for lf, p in acc.items():
        assert abs(got[lf] - (2 * p - 1)) < 0.08, (lf, got[lf])
    assert abs(got["word"] - (2 * 0.4 / 0.45 - 1)) < 0.12
    assert 0 <= got["lonely"] < 1
    items = spark.createDataFrame([(i,) for i in [*truth, 9999]], "id long")
    out = {r.item_id: r for r in weak.label_moments(L, items).collect()}
    maj = {r.item_id: r.label for r in weak.lf_majority(L, items).collect()}
    hits = sum(out[i].label == y for i, y in truth.items())
    assert hits / len(truth) > 0.85 and hits > sum(maj[i] == y for i, y in truth.items())
    assert (out[9999].p1, out[9999].label) == (0.5, 0)


def test_moments_of_few_votes(spark):
    schema = "item_id long, lf string, vote int"
    items = spark.createDataFrame([(1,), (2,)], "id long")
    for rows in ([], [(1, "a", 1)], [(1, "a", 1), (1, "b", 1)], [(1, "a", 0), (1, "b", 1), (2, "a", 1), (2, "b", -1)]):
        out = weak.label_moments(spark.createDataFrame(rows, schema), items).collect()
        assert len(out) == 2 and all(0 <= r.p1 <= 1 for r in out), rows


def test_majority_tie_abstains(spark):
    L = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 1)], "item_id long, lf string, vote int")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r["item_id"]: r["label"] for r in weak.lf_majority(L, items).collect()}
    assert got == {1: -1, 2: 1, 3: -1}


def test_change_answer(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,), (5,)], "a int")
    assert [r[0] for r in df.select(weak.change_answer("a")).collect()] == [0, -1, 1, -1]


def test_later_vote_wins(spark):
    v = spark.createDataFrame([(1, "w", 1, 10), (1, "w", -1, 20)],
                              "item_id long, worker_id string, answer int, pos long")
    assert weak.labels_by_annotator(v).first()["label"] == 1
