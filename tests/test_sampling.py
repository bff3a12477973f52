"""Samples and list scores: missing groups, missing and heavy users."""

import collections
import math

from pyspark.sql import functions as F

from tagtriage.operators import lists
from tagtriage.operators.sampling import holdout, weighted_sample
from tagtriage.session import cut_lineage

MOD = 2147483648


def _u(key, seed):
    k = ((key % 1000003) * 7919 + seed) % 1000003
    return ((k * 1103515245 + 12345) % MOD + 1) / (MOD + 1)


def test_rows_without_group_are_a_group(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], "_w") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, _w string")
    size = collections.Counter(g for _, g, _ in rows)
    want = sorted(rows, key=lambda r: (-math.log(_u(r[0], 5)) / size[r[1]], r[0]))[:40]
    got = weighted_sample(df, 40, "g", seed=5, hash="lcg")
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == set(want) and any(g is None for _, g, _ in want)
    assert weighted_sample(df, 1000, "g").count() == 300
    test, train = holdout(df, 30, None, "g", seed=1)
    assert test.count() == 30 and train.count() == 270


def test_list_scores_of_heavy_and_missing_users(spark):
    df = cut_lineage(spark.range(4000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(1000 + F.col("id") % 90).alias("user_id"),
        F.when(F.col("id") % 4 == 0, "bad word").otherwise("fine word").alias("processed_fulltext")))
    bl = spark.createDataFrame([(1001, 5), (1003, 9)], "user_id long, counts long")
    wl = spark.createDataFrame([(7, 8), (1003, 8), (1005, 8)], "user_id long, counts long")
    words = spark.createDataFrame([("bad", 1.0)], "word string, weight double")
    got = lists.wl_score(lists.bl_score(df, bl), wl, words).collect()
    assert len(got) == 4000 and len({r.id for r in got}) == 4000
    for r in got:
        black, white = r.user_id in (1001, 1003), r.user_id in (7, 1003, 1005)
        assert r.bl_label == (1.0 if black else 0.5)
        assert r.wl_label == (0.0 if white and not black and "bad" not in r.processed_fulltext else 0.5), r
