"""Boosted trees with exponential loss against a booster that looks at every row."""

import math
import random
import time

import numpy as np
import pytest

from tagtriage.operators import boosting as B


def brute(rows, rounds, depth, rate):
    """Row by row: every cut between values that occur, every leaf's rows."""
    y = [2 * r[-1] - 1 for r in rows]
    p = sum(r[-1] for r in rows) / len(rows)
    f = [0.5 * math.log(p / (1 - p))] * len(rows)
    for _ in range(rounds):
        t = [yi * math.exp(-yi * fi) for yi, fi in zip(y, f, strict=True)]
        leaves = [list(range(len(rows)))]
        for _ in range(depth):
            after = []
            for leaf in leaves:
                best = None
                for axis in range(len(rows[0]) - 1):
                    for edge in sorted({rows[i][axis] for i in leaf})[:-1]:
                        left = [i for i in leaf if rows[i][axis] <= edge]
                        right = [i for i in leaf if rows[i][axis] > edge]
                        gain = len(left) * len(right) / len(leaf) * (
                            sum(t[i] for i in left) / len(left) - sum(t[i] for i in right) / len(right)) ** 2
                        if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                            best = (gain, left, right)
                after += [leaf] if best is None else list(best[1:])
            leaves = after
        for leaf in leaves:
            step = sum(t[i] for i in leaf) / sum(abs(t[i]) for i in leaf)
            for i in leaf:
                f[i] += rate * step
    return [1 / (1 + math.exp(-2 * x)) for x in f]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = []
    for _ in range(160):
        a, b, c = rnd.randint(0, 9) / 10, rnd.randint(0, 6) / 8, rnd.randint(0, 3) / 4
        out.append((a, b, c, int(a + b * c + rnd.gauss(0, 0.3) > 0.8)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, a double, b double, c double, label int")


def test_equals_row_by_row(spark, rows):
    df = frame(spark, rows).repartition(3)
    edges = [sorted({r[k] for r in rows})[:-1] for k in range(3)]
    model = B.fit_boosted(df, ["a", "b", "c"], rounds=12, depth=3, subsample=1.0, rate=0.2, edges=edges)
    got = {r.id: r.p_meta for r in model.transform(df).collect()}
    want = brute(rows, 12, 3, 0.2)
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-9
    assert abs(sum(model.importances) - 1) < 1e-9 and model.importances[0] == max(model.importances)


def test_thousand_rounds_are_quick_and_repeatable(spark):
    rng = np.random.default_rng(0)
    n1 = rng.poisson(3, (32, 32, 32))
    n0 = rng.poisson(3, (32, 32, 32)) * (np.arange(32)[:, None, None] < 20)
    start = time.time()
    a, gains = B.boost_grid(n0, n1, 1000, 3, 0.5, 0.005, 222)
    assert time.time() - start < 20
    b, _ = B.boost_grid(n0, n1, 1000, 3, 0.5, 0.005, 222)
    assert (a == b).all() and a[25].mean() > a[5].mean() and gains[0] == gains.max()


def test_odd_rows_and_storage(spark, rows, tmp_path):
    df = frame(spark, rows)
    odd = spark.createDataFrame([(900, None, float("nan"), 0.5, 1), (901, 5.0, -5.0, None, None), (902, 0.5, 0.5, 0.5, 7)], df.schema)
    model = B.fit_boosted(df.unionByName(odd), ["a", "b", "c"], rounds=20, bins=4)
    scored = model.transform(df.unionByName(odd)).collect()
    assert len(scored) == len(rows) + 3 and all(0 < r.p_meta < 1 for r in scored)
    model.save(str(tmp_path / "m"))
    from tagtriage.sources.models import load_model
    again = {r.id: r.p_meta for r in load_model(str(tmp_path / "m")).transform(df).collect()}
    assert all(abs(again[r.id] - r.p_meta) < 1e-12 for r in scored if r.id in again)
    empty = B.fit_boosted(df.where("false"), ["a", "b", "c"], rounds=3)
    assert {round(r.p_meta, 6) for r in empty.transform(df).collect()} <= {0.0, 1e-06, 0.000001}
    with pytest.raises(ValueError, match="cells"):
        B.fit_boosted(df, ["a", "b", "c"], bins=100)
