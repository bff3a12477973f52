"""Ensemble votes and the override rule.

Row-wise column arithmetic only: these fuse into the projection of whatever
scan or join produced the base scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def override(col, bl: str = "bl_label", wl: str = "wl_label") -> Column:
    """H2: black list first (bl = 1 -> 1), then white list wins (wl = 0 -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(F.col(wl) == 0, F.lit(0.0))
             .when(F.col(bl) == 1, F.lit(1.0)).otherwise(c.cast("double")))


def binarise(df: DataFrame, bl: str = "bl_label", wl: str = "wl_label",
             others: tuple[str, ...] = ("rf_label", "ud_label", "txt_label")) -> DataFrame:
    """Bl < 1 -> 0 else 1; wl > 0 -> 1 else 0; other scores > 0.5 -> 1."""
    out = (df.withColumn(bl, F.when(F.col(bl) < 1, 0.0).otherwise(1.0))
             .withColumn(wl, F.when(F.col(wl) > 0, 1.0).otherwise(0.0)))
    for c in others:
        out = out.withColumn(c, F.when(F.col(c) > 0.5, 1.0).otherwise(0.0))
    return out


def vote_majority(df: DataFrame, cols: tuple[str, ...] = ("rf_label", "ud_label", "txt_label"),
                  out: str = "result") -> DataFrame:
    """H3: row-wise mode of the binarised scores (smallest value on a tie),
    then the override."""
    ones = sum(F.when(F.col(c) > 0.5, 1).otherwise(0) for c in cols)
    zeros = F.lit(len(cols)) - ones
    mode = F.when(ones > zeros, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumn(out, override(mode))


def vote_average(df: DataFrame, cols: tuple[str, ...] = ("rf_label", "ud_label", "txt_label"),
                 out: str = "result") -> DataFrame:
    """H4: plain mean of the scores, then the override."""
    mean = sum(F.col(c) for c in cols) / len(cols)
    return df.withColumn(out, override(mean))


def vote_weighted(df: DataFrame,
                  weights: tuple[tuple[str, float], ...] = (("bl_label", 0.1), ("wl_label", 0.1),
                                                            ("rf_label", 0.1), ("ud_label", 0.1),
                                                            ("txt_label", 0.6)),
                  normalise: bool = False, out: str = "result") -> DataFrame:
    """H5: mean of the weighted scores (sum / count, as the reference does,
    so the maximum is 0.2); ``normalise`` divides by the weight total
    instead. No override."""
    s = sum(F.col(c) * w for c, w in weights)
    div = sum(w for _, w in weights) if normalise else len(weights)
    return df.withColumn(out, s / div)


def vote_soft(df: DataFrame, cols: tuple[str, ...] = ("lr_label", "lr_label", "rf_label",
                                                      "nb_label", "ud_label", "cl_label",
                                                      "txt_label"),
              threshold: float = 0.5) -> DataFrame:
    """H6: ``label_prob`` = mean over the listed columns (lr twice, as in the
    reference; columns missing from ``df`` are skipped), ``label`` =
    label_prob > threshold, then the override."""
    present = [c for c in cols if c in df.columns]
    mean = sum(F.col(c) for c in present) / len(present)
    return (df.withColumn("label_prob", mean)
              .withColumn("label", override(F.when(F.col("label_prob") > threshold, 1.0)
                                             .otherwise(0.0)).cast("int")))


def agree_label(df: DataFrame, a: str = "lr_label", b: str = "nb_label", c: str = "rf_label",
                out: str = "label") -> DataFrame:
    """The shared prediction when all three models agree, else null."""
    return df.withColumn(out, F.when((F.col(a) == F.col(b)) & (F.col(c) == F.col(a)), F.col(a)))


def confident(df: DataFrame, prob: str = "label_prob", lo: float = 0.3,
              hi: float = 0.7) -> DataFrame:
    """Keep confident rows: p >= hi -> label 1, p <= lo -> label 0."""
    p = F.col(prob)
    return (df.filter((p >= hi) | (p <= lo))
              .withColumn("label", F.when(p >= hi, 1).otherwise(0)))
