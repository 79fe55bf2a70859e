"""Windows, numbering, folds, model parameter mapping and Gram-statistics adaptation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from lanespark.operators import features as FE
from lanespark.operators import online as ON
from lanespark.operators import split as SP
from lanespark.operators.ordering import global_row_number
from lanespark.sources import bindings as B


def _daily(spark, n_rows):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "R1", "A", float(100 + 10 * i), 30.0 + i, 50.0 - i)
            for i in range(n_rows)]
    return spark.createDataFrame(rows, "traffic_date date, road_name string, area_name string, volume double, "
                                       "avg_speed double, congestion double")


def test_lags_and_rolling_by_row(spark):
    out = FE.rolling_features(FE.lag_features(_daily(spark, 8))).orderBy("traffic_date").collect()
    assert out[6]["volume_lag7"] is None and out[7]["volume_lag7"] == 100.0
    assert out[0]["volume_rollstd3"] is None            # one row: sample std undefined
    assert out[0]["volume_rollmean3"] == 100.0           # min_periods = 1
    assert out[2]["volume_rollmean3"] == pytest.approx(110.0)
    for r in out:                                        # rolling mean within the frame's min..max
        assert 100.0 <= r["volume_rollmean7"] <= r["volume"]


def test_safe_mode_frames_exclude_current_row(spark):
    out = FE.rolling_features(_daily(spark, 4), leakage="safe").orderBy("traffic_date").collect()
    assert out[0]["volume_rollmean3"] is None
    assert out[1]["volume_rollmean3"] == 100.0


def test_label_encode_is_bijective(spark):
    d = B.daily_traffic(spark, SF_SMALL)
    enc = FE.label_encode(d, "road_name", "code").select("road_name", "code").distinct().collect()
    names = sorted(r[0] for r in enc)
    assert [r[1] for r in sorted(enc)] == list(range(len(names)))


def test_global_row_number_matches_sequential(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    got = global_row_number(df, ["k", "id"], "rn", num_partitions=7).select("k", "id", "rn").collect()
    ranked = sorted(got, key=lambda r: (r["k"], r["id"]))
    assert [r["rn"] for r in ranked] == list(range(1, 5001))


@pytest.mark.parametrize("n", [5, 12, 23, 100])
def test_contiguous_folds_have_ntile_sizes(spark, n):
    df = spark.range(1, n + 1).withColumn("fold", SP.contiguous_folds(F.col("id"), F.lit(n), 5))
    sizes = [r[1] for r in df.groupBy("fold").count().orderBy("fold").collect()]
    q, r = divmod(n, 5)
    assert sizes == [q + 1] * r + [q] * (5 - r)


def test_row_blocks_drop_tail_and_need_two(spark):
    df = spark.range(0, 250).withColumnRenamed("id", "k")
    b = SP.row_blocks(df, ["k"], 100)
    assert b.count() == 200 and sorted(r[0] for r in b.select("block").distinct().collect()) == [1, 2]
    assert SP.row_blocks(spark.range(0, 150).withColumnRenamed("id", "k"), ["k"], 100).count() == 0


def test_ridge_mapping_equals_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler
    from lanespark.operators import models as ML
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 4))
    y = X @ np.array([1.0, -2.0, 0.5, 3.0]) + 7 + rng.normal(scale=0.3, size=300)
    df = spark.createDataFrame([(*map(float, x), float(t)) for x, t in zip(X, y)], "a double, b double, c double, d double, label double")
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features_scaled").transform(df)
    alpha = 10.0
    sd, n = ML.label_sd_pop(df)
    m = ML.ridge(alpha, sd, n).fit(df)
    Xc = X - X.mean(0)
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(4), Xc.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), w, rtol=1e-6, atol=1e-8)


def test_gram_ridge_equals_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 3))
    y = X @ np.array([2.0, 0.0, -1.0]) + 1.0 + rng.normal(scale=0.1, size=400)
    rows = [(int(i % 4), [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "block int, x array<double>, y double")
    stats = ON.block_grams(df, "block", "x", "y", 3)
    G = sum(s["G"] for s in stats.values())
    xy = sum(s["xy"] for s in stats.values())
    w = ON.solve_ridge(G, xy, 0.5)
    X1 = np.hstack([X, np.ones((400, 1))])
    pen = np.eye(4) * 0.5
    pen[-1, -1] = 0
    assert np.allclose(w, np.linalg.solve(X1.T @ X1 + pen, X1.T @ y))
    assert stats[0]["n"] == 100


def test_leakage_parity_vs_safe(spark):
    from lanespark.plans.learning import QUERY_SIZES, fits, prepared
    one = [("Ridge Regression", "", QUERY_SIZES)]
    r_par, r_safe = (fits(spark, SF_SMALL, m).evaluate(one).first() for m in ("parity", "safe"))
    assert r_par["test_r2"] > 0.999999            # the identity volume = trend + lag3
    assert r_safe["test_r2"] < 0.999
    assert len(prepared(spark, SF_SMALL, "parity").feature_names) == 61


def test_online_adaptation_equals_numpy_refits(spark):
    rng = np.random.default_rng(2)
    p = 3
    Xtr = rng.normal(size=(200, p))
    Xte = rng.normal(size=(300, p)) + 0.5
    beta = np.array([1.0, -1.0, 2.0])
    ytr = Xtr @ beta + rng.normal(scale=0.5, size=200)
    yte = Xte @ (beta * 1.5) + 1.0 + rng.normal(scale=0.5, size=300)
    train = spark.createDataFrame([([float(v) for v in x], float(t)) for x, t in zip(Xtr, ytr)], "x array<double>, y double")
    test = spark.createDataFrame([(i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(Xte, yte))],
                                 "k long, x array<double>, y double")
    got = {r["block"]: (r["static_r2"], r["online_r2"])
           for r in ON.online_adaptation(train, test, ["k"], "x", "y", p, [100], 0.001, piece_rows=100).collect()}

    def fit(X, y):
        X1 = np.hstack([X, np.ones((len(X), 1))])
        pen = np.eye(p + 1) * 0.001
        pen[-1, -1] = 0
        return np.linalg.solve(X1.T @ X1 + pen, X1.T @ y)

    def r2(X, y, w):
        pred = np.hstack([X, np.ones((len(X), 1))]) @ w
        return 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    ws = fit(Xtr, ytr)
    for b in (1, 2, 3):
        Xb, yb = Xte[(b - 1) * 100:b * 100], yte[(b - 1) * 100:b * 100]
        wo = ws if b == 1 else fit(np.vstack([Xtr, Xte[:(b - 1) * 100]]), np.concatenate([ytr, yte[:(b - 1) * 100]]))
        assert got[b][0] == pytest.approx(r2(Xb, yb, ws), abs=1e-9)
        assert got[b][1] == pytest.approx(r2(Xb, yb, wo), abs=1e-9)


def test_group_lag_equals_window_lag_on_skewed_groups(spark):
    from pyspark.sql import Window
    from lanespark.operators.ordering import group_lag
    # group "hot" holds most rows and spans several range partitions
    df = spark.range(0, 3000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(
        F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.col("id") * 7919 % 3001).alias("o"), (F.col("id") * 1.5).alias("v"))
    got = group_lag(df, ["g"], ["o"], "v", "prev", num_partitions=6).select("g", "o", "prev").collect()
    exp = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g").orderBy("o"))).select("g", "o", "prev").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exp))


def test_online_adaptation_does_not_depend_on_the_pieces(spark):
    rng = np.random.default_rng(3)
    p = 2
    Xtr, Xte = rng.normal(size=(150, p)), rng.normal(size=(1130, p)) + 0.3
    ytr = Xtr @ np.array([1.0, 2.0]) + rng.normal(scale=0.3, size=150)
    yte = Xte @ np.array([1.5, 1.0]) + 0.5 + rng.normal(scale=0.3, size=1130)
    train = spark.createDataFrame([([float(v) for v in x], float(t)) for x, t in zip(Xtr, ytr)], "x array<double>, y double")
    test = spark.createDataFrame([(i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(Xte, yte))],
                                 "k long, x array<double>, y double")

    def run(rows):
        return {(r["window_size"], r["block"]): (r["static_r2"], r["online_r2"]) for r in ON.online_adaptation(
            train, test, ["k"], "x", "y", p, [100, 200, 1000], piece_rows=rows).collect()}
    one, many = run(100_000), run(1)
    assert sorted({k[0] for k in one}) == [100, 200]           # one block of 1000 is too few
    assert max(b for ws, b in one if ws == 100) == 11 and max(b for ws, b in one if ws == 200) == 5
    assert one.keys() == many.keys()
    for k, v in one.items():
        assert many[k] == pytest.approx(v, abs=1e-9)


def test_r2_from_statistics_keeps_its_digits_far_from_zero():
    rng = np.random.default_rng(4)
    X = np.hstack([rng.normal(size=(400, 2)), np.ones((400, 1))])
    y = X @ np.array([1.0, -2.0, 1e6]) + rng.normal(scale=0.5, size=400)
    s = dict(G=X.T @ X, xy=X.T @ y, yy=float(y @ y), n=400.0)
    w = np.linalg.lstsq(X, y, rcond=None)[0]
    true = 1 - ((y - X @ w) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert ON.r2_from_stats(s, w) == pytest.approx(true, abs=1e-3)
