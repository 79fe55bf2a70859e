"""kNN mutual information against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespark.operators import information as I


def psi(m):
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, int(m)))


def slow_mi(x, y, k):
    n = len(x)
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1][:, None]
    nx, ny = ((a < r).sum(axis=1) for a in (dx, dy))       # the point itself included
    table = np.array([0.0] + [psi(m) for m in range(1, n + 1)])
    return max(0.0, psi(n) + psi(k) - table[nx].mean() - table[ny].mean())


@pytest.mark.parametrize("leaf_rows", [8192, 40])
def test_mutual_information_is_brute_force(spark, leaf_rows):
    rng = np.random.default_rng(2)
    n = 700
    y = rng.normal(size=n) * 3000 + 20_000
    x = np.stack([y * 2 + rng.normal(size=n) * 100, rng.normal(size=n), rng.integers(0, 2, n) + 0.0, np.full(n, 7.0),
                  np.round(y / 4000), np.where(rng.random(n) < 0.4, 0.0, rng.exponential(size=n)), y], axis=1)
    df = spark.createDataFrame([(i, float(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, label double, x array<double>").repartition(5)
    names = list("abcdefg")
    got = {r.feature: r.mi_score for r in I.knn_mutual_information(df, names, 5, leaf_rows=leaf_rows).collect()}
    v = np.array([r.v for r in I.scaled(df, 7).orderBy("row_id").collect()])
    want = {f: slow_mi(v[:, i], v[:, 7], 5) for i, f in enumerate(names)}
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in names)
    assert want["a"] > 2 and want["b"] < 0.1


def test_digamma_of_small_and_large_numbers(spark):
    for m, got in spark.createDataFrame([(float(m),) for m in (1, 2, 5, 40, 1000)], "m double").select(
            "m", I.digamma(F.col("m"))).collect():
        assert got == pytest.approx(psi(m), abs=1e-11)


def test_few_rows(spark):
    rows = spark.createDataFrame([(1, 2.0, [3.0])], "row_id long, label double, x array<double>")
    assert I.knn_mutual_information(rows, ["a"]).collect()[0].mi_score == 0.0
    two = rows.union(spark.createDataFrame([(2, 5.0, [1.0])], rows.schema))
    assert I.knn_mutual_information(two, ["a"]).count() == 1
