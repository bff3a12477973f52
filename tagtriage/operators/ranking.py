"""Exact global row numbers and running totals without a single-partition window.

``Window.orderBy(x)`` with no partition moves every row into one task. At
scale we instead (``buckets`` and the salts follow
``spark.sql.shuffle.partitions``, which is set to the size of the job):

1. cut the key range into ~``buckets`` ranges at approximate quantiles (one
   aggregate row, so the cut list is bounded by ``buckets``),
2. total each range (a partial aggregate -> at most ``buckets`` rows),
3. turn those totals into offsets (a window over <= ``buckets`` rows),
4. finish with a window partitioned by range, so each task orders ~1/buckets
   of the data, and add the offset (broadcast: <= ``buckets`` rows).

The result is exact; only the balance of the ranges is approximate. Keys
with many equal values stay in one range, which is why callers
pre-aggregate to distinct keys first (e.g. one row per distinct score).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _spread(df: DataFrame, least: int) -> int:
    """How many ranges or salts: as many as a shuffle has partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_range(df: DataFrame, key: str, buckets: int, descending: bool) -> DataFrame:
    k = F.col(key).cast("double")
    if descending:
        k = -k
    keyed = df.withColumn("_rk", k)
    fracs = [i / buckets for i in range(1, buckets)]
    row = keyed.agg(F.percentile_approx("_rk", fracs, max(1000, 20 * buckets)).alias("q")).first()
    cuts = sorted({float(x) for x in (row["q"] or []) if x is not None})
    splits = [float("-inf")] + cuts + [float("inf")]
    if len(splits) < 3:
        return keyed.withColumn("_rng", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="_rk", outputCol="_rng",
                      handleInvalid="keep").transform(keyed)


def running_totals(df: DataFrame, order: list, sums: list[str], key: str | None = None,
                   descending: bool = False, buckets: int | None = None,
                   inclusive: bool = True) -> DataFrame:
    """Add ``cum_<c>`` for every ``c`` in ``sums``: the total of ``c`` over all
    rows ordered before (and, if ``inclusive``, including) this row.

    ``order`` is a list of column names (ascending unless ``descending``),
    the first of which is numeric and drives the range cut (``key``).
    Ties in ``order`` must not occur (callers add an id tiebreak).
    """
    key = key or order[0]
    buckets = buckets or _spread(df, 64)
    ranged = _with_range(df, key, buckets, descending)
    tot = ranged.groupBy("_rng").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wo = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_rng", *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0))
                                .alias(f"_o_{c}") for c in sums])
    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    end = 0 if inclusive else -1
    wi = Window.partitionBy("_rng").orderBy(*ocols).rowsBetween(Window.unboundedPreceding, end)
    out = ranged.join(F.broadcast(offs), "_rng", "left")
    for c in sums:
        out = out.withColumn(f"cum_{c}",
                             F.coalesce(F.sum(c).over(wi), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop("_rk", "_rng", *[f"_o_{c}" for c in sums])


def global_row_number(df: DataFrame, order: list[str], descending: bool = False,
                      buckets: int | None = None, out: str = "rn") -> DataFrame:
    """Exact 1-based row number over ``order`` (unique), computed in ranges."""
    r = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"],
                       descending=descending, buckets=buckets)
    return r.withColumnRenamed("cum__one", out).drop("_one")


def ntile_of(rn_col: str, n_col: str, k: int):
    """``ntile(k)`` from a 1-based row number and the row count: the first
    ``n % k`` tiles get one extra row (Spark / SQL rule)."""
    rn, n = F.col(rn_col), F.col(n_col)
    q = F.floor(n / k)
    r = n - q * k
    big = (q + 1) * r
    return (F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
             .otherwise(r + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))) + 1)).cast("int")


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int,
                    salts: int | None = None, out: str | None = None) -> DataFrame:
    """First ``n`` rows of every group by ``order`` (Column list), exact.

    Stage 1 ranks inside (group, salt) where salt = hash of the row, so a
    group holding a third of the data is sorted by ``salts`` tasks; only
    the <= salts * n survivors of each group meet in the stage-2 window.
    ``out`` names an optional 1-based rank column.
    """
    salts = salts or _spread(df, 32)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = (salted.withColumn("_r1", F.row_number().over(w1))
                 .filter(F.col("_r1") <= n).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group).orderBy(*order)
    res = pre.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= n)
    return res.withColumnRenamed("_r2", out) if out else res.drop("_r2")
