"""Quantiles by rank selection against numpy and Spark's own exact percentile."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespark.operators import profile as P
from lanespark.operators import quantiles as Q

SHARES = [0.0, 0.25, 0.5, 1.0]


def _columns():
    rng = np.random.default_rng(5)
    n = 1200
    third = np.where(rng.random(n) < 0.4, 7.5, rng.normal(size=n))                 # one value holds a third of the rows
    wide = np.sign(rng.normal(size=n)) * 10.0 ** rng.uniform(-300, 308, n)          # all sizes of numbers
    odd = np.where(rng.random(n) < 0.3, np.array([np.inf, -np.inf, np.nan])[rng.integers(0, 3, n)], rng.normal(size=n))
    return {"a": rng.normal(size=n), "third": third, "wide": wide, "odd": odd, "same": np.full(n, 3.0)}


@pytest.mark.parametrize("by,buckets,few", [([], 4096, 20_000), (["g"], 64, 60)])
def test_quantiles_equal_sorted_values(spark, by, buckets, few):
    cols = _columns()
    rows = [(["x", "y", None][i % 3], *[None if i % 11 == 0 else float(c[i]) for c in cols.values()], None)
            for i in range(len(cols["a"]))]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in cols) + ", none double").cache()
    got = {(*[r[b] for b in by], r.column_name): (r.n, r.q)
           for r in Q.exact_quantiles(df, [*cols, "none"], SHARES, by, buckets, few).collect()}
    agg = df.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in cols])
    want = {(*[r[b] for b in by], c): r[c] for r in agg.collect() for c in cols}
    assert set(got) == set(want)                                                # a column of nulls has no row
    for k, q in want.items():
        for x, y in zip(got[k][1], q):
            assert x == y or math.isnan(x) and math.isnan(y) or x == pytest.approx(y, rel=1e-12), (k, x, y)
    df.unpersist()


def test_quantiles_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(2.0,)], "x double")
    assert [tuple(r) for r in Q.exact_quantiles(one, ["x"], [0.25, 0.5]).collect()] == [("x", 1, [2.0, 2.0])]
    assert Q.exact_quantiles(one.limit(0), ["x"], [0.5]).count() == 0
    d = P.describe_numeric(one.limit(0), ["x"]).first()
    assert (d["count"], d.q50) == (0, None)


def test_quantiles_use_no_value_map(spark):
    """All aggregates are hash aggregates of fixed width; a value of a third of all rows is counted, not gathered."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.5).alias("x"))
    plans = []
    real = Q.cut_lineage

    def spy(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return real(frame)

    Q.cut_lineage = spy
    try:
        got = Q.exact_quantiles(df, ["x"], [0.1, 0.5], few=100).first().q
    finally:
        Q.cut_lineage = real
    xs = np.sort([5.0 if i % 3 == 0 else i * 0.5 for i in range(60_000)])
    assert got == pytest.approx(np.quantile(xs, [0.1, 0.5]))
    assert any("HashAggregate" in p for p in plans)
    assert not any("ObjectHashAggregate" in p or "SortAggregate" in p for p in plans)
