"""Joins on keys of which one may hold a large share of the rows.

Spark splits a skewed join only between plain exchanges; where one side is a
fresh aggregate, or the plan holds other operators between, a hot key is one
task. ``hot_join`` finds the heavy keys first and deals their rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# keys looked at as possibly heavy, and those that the sketch keeps track of
HEAVY, TRACKED = 200, 10_000


def heavy_keys(df: DataFrame, on: list[str], share: float) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows. A frequent-items
    sketch in the partial aggregate, so its size is fixed whatever the keys."""
    h = F.xxhash64(*[F.col(c) for c in on]).alias("h")
    r = df.select(h).agg(F.expr(f"approx_top_k(h, {HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in (r["top"] or []) if x["count"] >= share * r["n"] and x["count"] > 1]


def hot_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner", salts: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner, left, left_semi or left_anti) with the
    rows of heavy keys dealt to ``salts`` places and the right side's rows of those
    keys repeated there. ``left`` is read twice (by the sketch and by the join):
    pass a stored table. A row of ``left`` has one place, so the result is that
    of the plain join; where no key is heavy it is the plain join."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"hot_join has no {how!r} join")
    on = [on] if isinstance(on, str) else list(on)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = salts or max(2, parts)
    heavy = heavy_keys(left, on, 0.5 / parts)
    if not heavy:
        return left.join(right, on, how)

    def is_heavy() -> Column:
        return F.xxhash64(*[F.col(c) for c in on]).isin(heavy)

    dealt = left.withColumn("_salt", F.when(is_heavy(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).otherwise(0).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    spread = right.withColumn("_salt", F.explode(F.when(is_heavy(), every).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")
