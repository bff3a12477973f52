"""Learning curve of a selection strategy (M22): train on the first n picks,
score a fixed test set, report F1 per (method, size); random picks are
repeated over seeds and summarised by mean / min / max."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtriage.operators.evaluate import prf
from tagtriage.operators.sampling import uniform


def learning_curve(train: DataFrame, test: DataFrame, picks: dict, sizes: list[int],
                   fit_score, label: str = "label", key: str = "id",
                   parallelism: int = 4) -> DataFrame:
    """``picks``: method -> DataFrame (id, rank) or list of such frames (one
    per seed); ``fit_score(train, test) -> test with 'score'``.
    -> (method, size, f1_mean, f1_min, f1_max), plus method 'full'."""
    from tagtriage.session import parallel_map
    spark = train.sparkSession
    jobs = []
    for method, p in picks.items():
        runs = p if isinstance(p, list) else [p]
        for n in sizes:
            for r in runs:
                jobs.append((method, n, r))

    def f1_of(job):
        method, n, r = job
        sub = train.join(r.filter(F.col("rank") <= n).select(F.col("id").alias(key)),
                         key, "left_semi")
        return prf(fit_score(sub, test), "score", label).first()["f1"]

    scores = parallel_map(f1_of, jobs, parallelism)
    by: dict = {}
    for (method, n, _), f1 in zip(jobs, scores):
        by.setdefault((method, n), []).append(f1)
    rows = [(m, n, sum(v) / len(v), min(v), max(v)) for (m, n), v in by.items()]
    full = prf(fit_score(train, test), "score", label).first()["f1"]
    n_all = train.count()
    rows.append(("full", n_all, full, full, full))
    return spark.createDataFrame(rows, "method string, size long, f1_mean double, "
                                       "f1_min double, f1_max double")


def random_orders(rows: DataFrame, seeds, most: int, key: str = "id", hash: str = "xx") -> DataFrame:
    """(method, seed, id, rank): the first ``most`` rows of a random order a seed."""
    out = None
    for seed in seeds:
        first = rows.select(F.col(key).alias("id"), uniform(key, seed, hash).alias("_u")).orderBy("_u", "id").limit(most)
        one = first.select(F.lit("random").alias("method"), F.lit(seed).alias("seed"), "id",
                           F.row_number().over(Window.orderBy("_u", "id")).alias("rank"))  # ``most`` rows
        out = one if out is None else out.unionByName(one)
    return out


def nb_learning_curve(train: DataFrame, test: DataFrame, picks: DataFrame, sizes: list[int], cols: list[str],
                      label: str = "label", key: str = "id", var_smoothing: float = 1e-9) -> DataFrame:
    """M22 for Gaussian naive Bayes, all sizes and seeds at once: F1 on ``test`` of the
    models of the first n picks, (method, size, f1_mean, f1_min, f1_max) over
    the seeds. ``picks``: (method, seed, id, rank).

    The model is sums: a pick goes to the smallest size that holds it, and sizes
    add up. So the picks are read once, not once a size, and ``test`` once for
    all models, whose parameters (methods x seeds x sizes x classes x columns,
    the caller's numbers) go to the tasks."""
    sizes = sorted(set(sizes))
    first = F.coalesce(*[F.when(F.col("rank") <= n, F.lit(n)) for n in sizes])
    x = [F.col(c).cast("double") for c in cols]
    held = (picks.join(train.select(F.col(key).alias("id"), F.col(label).cast("int").alias("cls"), *[v.alias(f"x{i}") for i, v in enumerate(x)]), "id")
            .withColumn("first", first).where("first IS NOT NULL"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(len(cols))] + [F.sum(F.col(f"x{i}") * F.col(f"x{i}")).alias(f"q{i}") for i in range(len(cols))]
    rows = held.groupBy("method", "seed", "first", "cls").agg(F.count(F.lit(1)).alias("n"), *sums).toPandas()
    models = []
    for (method, seed), g in rows.groupby(["method", "seed"]):
        for n in sizes:
            part = g[g["first"] <= n].drop(columns=["method", "seed", "first"]).groupby("cls").sum()
            if not len(part):
                continue
            count = part["n"].to_numpy(float)
            S, Q = (part[[f"{c}{i}" for i in range(len(cols))]].to_numpy(float) for c in "sq")
            whole = Q.sum(0) / count.sum() - (S.sum(0) / count.sum()) ** 2
            mean = S / count[:, None]
            var = np.maximum(Q / count[:, None] - mean ** 2, 0) + max(whole.max(), 0) * var_smoothing
            models.append((method, int(seed), n, part.index.to_numpy(), np.log(count / count.sum()), mean, np.maximum(var, 1e-300)))

    def score(batches):
        for pdf in batches:
            X, y = pdf[[f"x{i}" for i in range(len(cols))]].to_numpy(float), pdf["y"].to_numpy()
            out = []
            for method, seed, n, classes, prior, mean, var in models:
                joint = np.stack([p - 0.5 * (np.log(2 * np.pi * v) + (X - m) ** 2 / v).sum(1) for p, m, v in zip(prior, mean, var)])
                one = np.flatnonzero(classes == 1)
                if not len(one):
                    hit = np.zeros(len(X), bool)
                else:
                    with np.errstate(over="ignore"):
                        hit = 1 / np.exp(joint - joint[one[0]]).sum(0) > 0.5
                out.append((method, seed, n, int((hit & (y == 1)).sum()), int((hit & (y != 1)).sum()), int((~hit & (y == 1)).sum())))
            yield pd.DataFrame(out, columns=["method", "seed", "size", "tp", "fp", "fn"])

    counts = (test.select(F.col(label).cast("int").alias("y"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
              .mapInPandas(score, "method string, seed long, size long, tp long, fp long, fn long")
              .groupBy("method", "seed", "size").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return (counts.withColumn("f1", f1).groupBy("method", "size")
            .agg(F.avg("f1").alias("f1_mean"), F.min("f1").alias("f1_min"), F.max("f1").alias("f1_max")))
