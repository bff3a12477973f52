"""Ranged running totals equal single-partition windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagtriage.operators.ranking import global_row_number, ntile_of, running_totals, top_n_per_group


def test_running_totals_match_window(spark):
    rnd = random.Random(1)
    data = [(i, rnd.random(), rnd.randint(0, 3)) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, s double, v long")
    got = {r["id"]: r["cum_v"] for r in running_totals(df, ["s", "id"], ["v"], buckets=16).collect()}
    w = Window.orderBy("s", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = {r["id"]: r["c"] for r in df.select("id", F.sum("v").over(w).alias("c")).collect()}
    assert got == exp


def test_row_number_and_ntile_rule(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    r = global_row_number(df, ["k"], buckets=4).withColumn("n", F.lit(10))
    tiles = [x["t"] for x in r.select(ntile_of("rn", "n", 4).alias("t"), "k").orderBy("k").collect()]
    assert tiles == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_top_n_per_group_hot_key(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v long")
    out = top_n_per_group(df, ["g"], [F.col("v").desc()], 5, out="r").collect()
    hot = sorted(r["v"] for r in out if r["g"] == "hot")
    assert hot == [4995, 4996, 4997, 4998, 4999]
    assert len([r for r in out if r["g"] == "cold"]) == 3
