"""Sampling, splits and set operations.

Randomness is a pure function of (row id, seed), so every task -- and every
retry after a lost executor -- draws the same numbers. ``hash='xx'`` uses
Spark's xxhash64; ``hash='lcg'`` is an integer formula that other engines
reproduce exactly (used by the SQL oracles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtriage.operators.cleaning import strict_unique
from tagtriage.operators.ranking import global_row_number, ntile_of
from tagtriage.operators.skew import hot_join

_TWO31 = 2147483648


def uniform(key: str, seed: int, hash: str = "xx") -> Column:
    """u in (0, 1) from a row key and a seed."""
    if hash == "lcg":
        k = F.pmod(F.pmod(F.col(key), F.lit(1000003)) * 7919 + seed, F.lit(1000003))
        v = F.pmod(k * 1103515245 + 12345, F.lit(_TWO31))
        return (v + 1) / F.lit(_TWO31 + 1)
    v = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(_TWO31))
    return (v + 1) / F.lit(_TWO31 + 1)


def uniform_sql(key: str, seed: int) -> str:
    """DuckDB twin of ``uniform(..., hash='lcg')``."""
    k = f"((({key} % 1000003) * 7919 + {seed}) % 1000003)"
    return f"((({k} * 1103515245 + 12345) % {_TWO31}) + 1) / {_TWO31 + 1}.0"


def weighted_sample(df: DataFrame, n: int, group: str, seed: int = 0, key: str = "id",
                    proportional: bool = False, hash: str = "xx") -> DataFrame:
    """N rows without replacement, weight = size of the row's group
    (the reference's rule; ``proportional`` gives every row weight 1).

    Efraimidis-Spirakis: the n smallest ``-ln(u) / w``. Rows without a group are
    a group of their own. Group sizes are a partial aggregate joined back, rows
    of a large group dealt out; the n smallest keys come from Spark's
    distributed top-k (each task keeps n, one merge of tasks x n rows).
    """
    u = uniform(key, seed, hash)
    if proportional:
        keyed = df.withColumn("_es", -F.log(u))
    else:
        grouped = df.withColumn("_group", F.struct(F.col(group)))  # structs of nulls are equal
        sizes = grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_group_size"))
        keyed = (hot_join(grouped, sizes, "_group").withColumn("_es", -F.log(u) / F.col("_group_size"))
                 .select(*[F.col(f"`{c}`") for c in df.columns], "_es"))
    return keyed.orderBy("_es", key).limit(n).drop("_es")


def holdout(df: DataFrame, n_test: int, n_train: int | None, group: str, seed: int = 0,
            key: str = "id", hash: str = "xx") -> tuple[DataFrame, DataFrame]:
    """test = weighted sample; train = weighted sample of the rest
    (or all of the rest when ``n_train`` is None)."""
    test = weighted_sample(df, n_test, group, seed, key, hash=hash)
    rest = df.join(test.select(key), key, "left_anti")
    train = rest if n_train is None else weighted_sample(rest, n_train, group, seed + 1, key,
                                                         hash=hash)
    return test, train


def merge_sets(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Union, then strict unique on ``key``."""
    return strict_unique(a.unionByName(b, allowMissingColumns=True), key)


def exclude_in(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    """C4: rows whose key does not occur in ``other`` (anti join)."""
    return df.join(other.select(key), key, "left_anti")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append rows; missing columns become null."""
    return a.unionByName(b, allowMissingColumns=True)


def random_head(df: DataFrame, n: int, seed: int = 0, key: str = "id",
                hash: str = "xx") -> DataFrame:
    """The first n rows of a seeded shuffle (distributed top-k)."""
    return (df.withColumn("_u", uniform(key, seed, hash))
              .orderBy("_u", key).limit(n).drop("_u"))


def split(df: DataFrame, frac: float = 0.5, seed: int = 0, key: str = "id",
          hash: str = "xx") -> tuple[DataFrame, DataFrame]:
    """Seeded split; both parts are filters over the same hash."""
    u = uniform(key, seed, hash)
    return df.filter(u < frac), df.filter(u >= frac)


def kfold(df: DataFrame, k: int, mode: str = "contiguous", seed: int = 0,
          key: str = "id", out: str = "fold", hash: str = "xx") -> DataFrame:
    """Fold numbers 1..k.

    ``contiguous``: folds of consecutive ids with the ntile size rule (first
    n mod k folds one larger), via an exact ranged row number instead of a
    single-partition window. ``shuffled``: fold from the seeded hash.
    """
    if mode == "contiguous":
        n = df.count()
        ranked = global_row_number(df, [key], out="_rn").withColumn("_n", F.lit(n))
        return ranked.withColumn(out, ntile_of("_rn", "_n", k)).drop("_rn", "_n")
    return df.withColumn(out, (F.floor(uniform(key, seed, hash) * k) + 1).cast("int"))


def balance(pos: DataFrame, neg: DataFrame, mode: str = "equal", seed: int = 0,
            key: str = "id", hash: str = "xx") -> DataFrame:
    """C10: 'equal' keeps all of the smaller class and the same number of the
    larger class (its smallest seeded hashes); 'all' keeps everything."""
    if mode == "all":
        return pos.unionByName(neg)
    npos, nneg = pos.count(), neg.count()
    small, big, m = (pos, neg, npos) if npos <= nneg else (neg, pos, nneg)
    ranked = global_row_number(big.withColumn("_u", uniform(key, seed, hash)), ["_u", key],
                               out="_rn")
    return small.unionByName(ranked.filter(F.col("_rn") <= m).drop("_u", "_rn"))
