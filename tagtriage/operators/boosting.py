"""Boosted trees with exponential loss on a bounded histogram (H9).

The learner's inputs are a few scores. One job reads quantile edges, one counts
the rows of each class in each cell of the grid that they span: at most
``bins ** len(cols)`` cells, whatever the number of rows. All rounds run on that
grid; a tree's nodes are boxes of cells. The fitted ensemble is one value a
cell, so that scoring any number of rounds is a look-up in a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtriage.session import current_session

MAX_CELLS = 1 << 18


@dataclass
class BoostedGrid:
    """A fitted ensemble: per column its inner bin edges, per cell the margin."""

    cols: list[str]
    edges: list[list[float]]
    margin: np.ndarray
    importances: list[float]

    def cell(self) -> Column:
        """Index of the row's cell; a null or NaN score lies below every edge."""
        out = F.lit(0)
        for c, edges in zip(self.cols, self.edges, strict=True):
            x = F.nanvl(F.col(c).cast("double"), F.lit(float("-inf")))
            place = sum([F.when(x > float(e), 1).otherwise(0) for e in edges], F.lit(0))
            out = out * (len(edges) + 1) + place
        return out.cast("int")

    def transform(self, df: DataFrame, out: str = "p_meta") -> DataFrame:
        """``df`` with the probability of class 1 in ``out``. The joined table has a
        row a cell, MAX_CELLS at most, and is broadcast."""
        import pandas as pd
        margin = self.margin.ravel()
        cells = df.sparkSession.createDataFrame(pd.DataFrame({"__cell": np.arange(margin.size, dtype=np.int32),
                                                              out: 1 / (1 + np.exp(-2 * margin))}))
        return df.withColumn("__cell", self.cell()).join(F.broadcast(cells), "__cell").drop("__cell")

    def save(self, path: str) -> None:
        rows = [(self.cols, self.edges, [float(x) for x in self.margin.ravel()], self.importances)]
        (current_session().createDataFrame(rows, "cols array<string>, edges array<array<double>>, margin array<double>, "
                                                 "importances array<double>")
         .coalesce(1).write.mode("overwrite").parquet(path))

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedGrid:
        r = spark.read.parquet(path).first()
        edges = [list(e) for e in r.edges]
        return BoostedGrid(list(r.cols), edges, np.array(r.margin).reshape([len(e) + 1 for e in edges]), list(r.importances))


def _best_split(weight: np.ndarray, target: np.ndarray) -> tuple[float, int, int] | None:
    """The cut of a box with the largest w_l w_r / (w_l + w_r) (mean_l - mean_r)**2:
    (gain, axis, cells on the left); the first of equal ones, None if there is none."""
    best = None
    for axis in range(weight.ndim):
        others = tuple(a for a in range(weight.ndim) if a != axis)
        w, t = weight.sum(axis=others).cumsum(), target.sum(axis=others).cumsum()
        wl, tl = w[:-1], t[:-1]
        wr, tr = w[-1] - wl, t[-1] - tl
        ok = (wl > 0) & (wr > 0)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, wl * wr / (wl + wr) * (tl / wl - tr / wr) ** 2, -1.0)
        k = int(np.argmax(gain))
        if gain[k] > 1e-12 and (best is None or gain[k] > best[0] * (1 + 1e-12)):
            best = (float(gain[k]), axis, k + 1)
    return best


def boost_grid(n0: np.ndarray, n1: np.ndarray, rounds: int, depth: int, subsample: float, rate: float,
               seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(margin of every cell, gain of every axis) from the rows of class 0 and 1 a cell.

    Starts from half the log odds. A round fits a regression tree of ``depth``
    to y exp(-y margin), y being -1 or 1, on a seeded draw of the rows (binomial
    in each cell and class), and moves each leaf by ``rate`` times
    sum(y exp(-y margin)) / sum(exp(-y margin)) over the rows drawn."""
    total0, total1 = n0.sum(), n1.sum()
    p = min(max(total1 / max(total0 + total1, 1), 1e-6), 1 - 1e-6)
    margin, gains = np.full(n0.shape, 0.5 * np.log(p / (1 - p))), np.zeros(n0.ndim)
    for r in range(rounds):
        a0, a1 = n0, n1
        if subsample < 1:
            rng = np.random.default_rng([seed, r])
            a0, a1 = rng.binomial(n0, subsample), rng.binomial(n1, subsample)
        up, down = a1 * np.exp(-margin), a0 * np.exp(margin)
        weight, target, scale = (a0 + a1).astype(float), up - down, up + down
        boxes = [(slice(None),) * n0.ndim]
        for _ in range(depth):
            after = []
            for box in boxes:
                cut = _best_split(weight[box], target[box])
                if cut is None:
                    after.append(box)
                    continue
                gain, axis, k = cut
                gains[axis] += gain
                start = box[axis].start or 0
                after += [(*box[:axis], slice(box[axis].start, start + k), *box[axis + 1:]),
                          (*box[:axis], slice(start + k, box[axis].stop), *box[axis + 1:])]
            boxes = after
        for box in boxes:
            below = scale[box].sum()
            if below > 1e-150:
                margin[box] += rate * target[box].sum() / below
    return margin, gains


def grid_edges(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Inner edges of about ``bins`` equally filled bins a column (within 0.1 % of
    rank), each a value that occurs: rows above it go to the right."""
    if bins ** len(cols) > MAX_CELLS:
        raise ValueError(f"{bins} bins of {len(cols)} columns are more than {MAX_CELLS} cells")
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    found = clean.approxQuantile(list(cols), [k / bins for k in range(1, bins)], 0.001)
    return [sorted(set(e)) for e in found]


def fit_boosted(df: DataFrame, cols: list[str], label: str = "label", rounds: int = 1000, depth: int = 3,
                subsample: float = 0.5, rate: float = 0.005, seed: int = 222, bins: int = 32,
                edges: list[list[float]] | None = None) -> BoostedGrid:
    """Fit on ``cols`` and a 0 / 1 label. Two jobs read the rows; the driver holds
    the counts of at most ``bins ** len(cols)`` cells, however many rows there
    are. Rows whose label is neither 0 nor 1 are left out; without rows of both
    classes every score is the prior. ``edges`` names the inner bin edges of
    every column instead of the quantiles."""
    df = df.where(F.col(label).isin(0, 1))
    edges = grid_edges(df, list(cols), bins) if edges is None else [sorted(set(map(float, e))) for e in edges]
    if np.prod([len(e) + 1 for e in edges]) > MAX_CELLS:
        raise ValueError(f"the edges span more than {MAX_CELLS} cells")
    model = BoostedGrid(list(cols), edges, np.zeros([len(e) + 1 for e in edges]), [])
    counts = df.groupBy(model.cell().alias("cell")).agg(
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n0"), F.count(F.lit(1)).alias("n")).collect()
    n0, n1 = (np.zeros(model.margin.size, np.int64) for _ in range(2))
    for r in counts:
        n0[r["cell"]], n1[r["cell"]] = r["n0"], r["n"] - r["n0"]
    shape = model.margin.shape
    model.margin, gains = boost_grid(n0.reshape(shape), n1.reshape(shape), rounds, depth, subsample, rate, seed)
    total = gains.sum()
    model.importances = [float(g / total) if total > 0 else 1.0 / len(cols) for g in gains]
    return model
