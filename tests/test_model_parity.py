"""Queries without a SQL oracle: closed forms, optimality conditions, properties and recomputation."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from small_data import SF_SMALL
from lanespark.operators import fits as FT
from lanespark.operators import models as ML
from lanespark.plans import learning as L
from lanespark.plans import registry

registry.load_all()


FEW: dict = {}


@pytest.fixture(scope="module", autouse=True)
def few(spark, tmp_path_factory):
    """A table of some hundred daily rows: the full-size models are fitted to it once for all tests here."""
    import shutil
    folder = tmp_path_factory.mktemp("few")
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where("l_orderkey % 5 = 0").coalesce(1) \
        .write.parquet(str(folder / "part"))
    shutil.copy(next((folder / "part").glob("part-*.parquet")), folder / "lineitem.parquet")
    FEW["sf"] = str(folder)


def query(spark, key):
    return registry.QUERIES[key](spark, FEW["sf"])


@pytest.fixture(scope="module")
def small(spark):
    """400 rows with known vectors, as a frame and as arrays."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(400, 6))
    X = (X - X.mean(0)) / X.std(0)
    y = X @ np.array([3.0, -2.0, 0.0, 0.0, 1.0, 0.0]) + 5.0 + rng.normal(scale=0.3, size=400)
    df = spark.createDataFrame([(i, [float(v) for v in x], float(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "row_id long, x array<double>, label double")
    return df.withColumn("features_scaled", array_to_vector("x")), X, y


def coefficients(model):
    return np.append(model.coefficients.toArray(), model.intercept)


def test_linear_and_ridge_are_their_closed_forms(small):
    df, X, y = small
    X1 = np.hstack([X, np.ones((len(X), 1))])
    assert np.allclose(coefficients(ML.linear().fit(df)), np.linalg.lstsq(X1, y, rcond=None)[0], atol=1e-5)
    pen = np.diag([7.0] * 6 + [0.0])
    got = coefficients(ML.ridge(7.0, float(y.std()), len(y)).fit(df))
    assert np.allclose(got, np.linalg.solve(X1.T @ X1 + pen, X1.T @ y), rtol=5e-3, atol=5e-3)


def test_lasso_meets_its_optimality_conditions(small):
    df, X, y = small
    w = coefficients(ML.lasso(0.2).fit(df))
    grad = X.T @ (y - X @ w[:-1] - w[-1]) / len(y)
    for g, c in zip(grad, w[:-1]):
        assert abs(g) <= 0.2 + 5e-3 and (c == 0 or abs(g - 0.2 * np.sign(c)) < 5e-3)
    assert sum(w[:-1] == 0) >= 2


def test_elastic_net_meets_its_optimality_conditions(small):
    df, X, y = small
    alpha, ratio = 0.3, 0.5
    w = coefficients(ML.elastic_net(alpha, ratio, float(y.std())).fit(df))
    grad = X.T @ (y - X @ w[:-1] - w[-1]) / len(y) - alpha * (1 - ratio) * w[:-1]
    for g, c in zip(grad, w[:-1]):
        assert abs(g) <= alpha * ratio + 1e-2 and (c == 0 or abs(g - alpha * ratio * np.sign(c)) < 1e-2)


@pytest.mark.parametrize("key", ["linear_regression", "lasso", "elastic_net", "knn_regression", "decision_tree",
                                 "random_forest", "extra_trees", "gradient_boosting"])
def test_variant_rows_are_consistent(spark, key):
    r = query(spark, key).collect()
    assert len(r) == 1
    r = r[0]
    assert r.train_r2 <= 1 and r.test_r2 <= 1 and r.train_r2 > 0.5
    assert r.test_rmse >= r.test_mae > 0 and r.train_rmse >= r.train_mae - 1e-9
    assert r.r2_gap == pytest.approx(r.train_r2 - r.test_r2)


def test_boosting_lowers_the_training_loss(spark):
    rows = query(spark, "boosting_curve").orderBy("iteration").collect()
    loss = [r.loss for r in rows]
    assert [r.iteration for r in rows] == list(range(1, L.QUERY_SIZES["gb_iter"] + 1))
    assert all(b <= a * (1 + 1e-9) for a, b in zip(loss, loss[1:]))


def test_coefficients_importances_and_eliminated_features(spark):
    names = set(L.prepared(spark, FEW["sf"]).feature_names)
    c = query(spark, "coefficient_table").collect()
    assert {r.feature for r in c} == names
    assert [r.abs_coefficient for r in c] == sorted((r.abs_coefficient for r in c), reverse=True)
    gone = query(spark, "lasso_eliminated").collect()
    assert {r.feature for r in gone} <= names and all(r.n_kept + len(gone) == len(names) for r in gone)
    imp = query(spark, "rf_importance").collect()
    assert {r.feature for r in imp} == names and sum(r.importance for r in imp) == pytest.approx(1.0)


def _train_arrays(spark, prep):
    rows = L._fold_rows(prep).orderBy("row_id").collect()
    return (np.array([r.x for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows]),
            [r.row_id for r in rows])


def test_cross_validation_equals_numpy(spark):
    prep = L.prepared(spark, FEW["sf"], "safe")
    X, y, fold, ids = _train_arrays(spark, prep)
    from lanespark.operators import online as ON
    X1 = np.hstack([X, np.ones((len(X), 1))])
    pen = np.eye(X1.shape[1])
    pen[-1, -1] = 0
    want, said = {}, np.zeros(len(y))
    for f in range(1, 6):
        tr, te = fold != f, fold == f
        w = np.linalg.lstsq(X1[tr].T @ X1[tr] + pen, X1[tr].T @ y[tr], rcond=None)[0]
        said[te] = X1[te] @ w
        want[f] = 1 - ((y[te] - said[te]) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
    for _, f, _, cv in ON.ridge_path(FT.of(prep).grams(), [1.0]):
        assert cv == pytest.approx(want[f], abs=1e-6)
    sizes = dict(L.QUERY_SIZES, ridge_alpha=1.0)
    held = {r.row_id: r.prediction for r in list(FT.of(prep).held([("Ridge Regression", sizes)]).values())[0].collect()}
    assert np.allclose([held[i] for i in ids], said, rtol=1e-6)
    row = FT.of(prep).cv([("Ridge Regression", sizes)]).first()
    assert row.cv_r2 == pytest.approx(np.mean(list(want.values())), abs=1e-6) and row.folds == 5
    assert row.cv_std == pytest.approx(np.std(list(want.values())), abs=1e-6)


def test_lasso_by_gram_meets_its_optimality_conditions(small):
    from lanespark.operators import online as ON
    _, X, y = small
    X1 = np.hstack([X, np.ones((len(X), 1))])
    for alpha, ratio in ((0.2, 1.0), (0.3, 0.5)):
        w = ON.solve_l1(X1.T @ X1, X1.T @ y, float(len(y)), alpha, ratio)
        grad = X.T @ (y - X1 @ w) / len(y) - alpha * (1 - ratio) * w[:-1]
        for g, c in zip(grad, w[:-1]):
            assert abs(g) <= alpha * ratio + 1e-7 and (c == 0 or abs(g - alpha * ratio * np.sign(c)) < 1e-7)
        assert abs((y - X1 @ w).mean()) < 1e-9


def test_neighbours_and_trees_of_the_folds_are_brute_force(spark):
    prep = L.prepared(spark, FEW["sf"], "safe")
    X, y, fold, ids = _train_arrays(spark, prep)
    held = FT.of(prep).held([("KNN", L.QUERY_SIZES), ("Decision Tree", L.QUERY_SIZES)])
    knn, tree = ({r.row_id: r.prediction for r in d.collect()} for d in held.values())
    assert set(knn) == set(tree) == set(ids)
    for i in range(0, len(ids), 7):
        rest = np.nonzero(fold != fold[i])[0]
        d = np.sqrt(((X[rest] - X[i]) ** 2).sum(axis=1))
        near = rest[np.lexsort((np.array(ids)[rest], d))[:8]]
        dn = np.sqrt(((X[near] - X[i]) ** 2).sum(axis=1))
        want = y[near][dn == 0].mean() if (dn == 0).any() else (y[near] / dn).sum() / (1 / dn).sum()
        assert knn[ids[i]] == pytest.approx(want)


def test_every_family_is_cross_validated_and_evaluated(spark):
    cv = {r.model: r for r in query(spark, "cross_validate").collect()}
    assert set(cv) == set(FT.FAMILIES) and all(r.folds == 5 and r.cv_r2 <= 1 and r.cv_std >= 0 for r in cv.values())
    rows = {r.model: r for r in query(spark, "evaluate_variant").collect()}
    assert set(rows) == set(FT.FAMILIES)
    assert all(rows[m].cv_r2 == pytest.approx(cv[m].cv_r2) for m in cv)
    curve = {r.alpha: r for r in query(spark, "validation_curve").collect()}
    assert curve[0.001].cv_r2 == pytest.approx(cv["Ridge Regression"].cv_r2, abs=1e-6)
    assert [a for a, r in curve.items() if r.is_best] == [max(curve, key=lambda a: curve[a].cv_r2)]


def test_depth_curve_is_whole(spark):
    rows = query(spark, "depth_curve").orderBy("max_depth").collect()
    assert [r.max_depth for r in rows] == list(range(2, 25)) and sum(r.is_best for r in rows) == 1
    train = [r.train_r2 for r in rows]
    assert all(b >= a - 1e-12 for a, b in zip(train, train[1:])) and all(r.cv_r2 <= r.train_r2 for r in rows)
    best = next(r for r in rows if r.is_best)
    assert best.cv_r2 == max(r.cv_r2 for r in rows)


def test_window_summary_summarises_the_windows(spark):
    w = query(spark, "online_windows").collect()
    static = query(spark, "static_windows").collect()
    assert sorted((r.window_size, r.block, r.static_r2) for r in w) == sorted(tuple(r) for r in static)
    gain = {r.window_size: r for r in query(spark, "adaptation_gain").collect()}
    for s in query(spark, "window_summary").collect():
        mine = [r for r in w if r.window_size == s.window_size]
        a, b = np.mean([r.static_r2 for r in mine]), np.mean([r.online_r2 for r in mine])
        assert s.n_windows == len(mine) and s.avg_static_r2 == pytest.approx(a) and s.avg_online_r2 == pytest.approx(b)
        assert gain[s.window_size].gain_pct == pytest.approx((b - a) / (abs(a) + 1e-10) * 100, abs=1e-9)


def test_framework_run_is_whole(spark):
    rows = {r.model: r for r in query(spark, "run_framework").collect()}
    assert set(rows) == set(L._FRAMEWORK_MODELS) | {"Weighted Ensemble", "Stacking Ensemble"}
    assert sorted(r["rank"] for r in rows.values()) == list(range(1, 12))
    weights = [rows[n].weight for n in L._STACK_BASES]
    assert sum(weights) == pytest.approx(1.0) and all(w >= 0 for w in weights)
    positive = [max(rows[n].cv_r2, 0) for n in L._STACK_BASES]
    assert weights == pytest.approx([p / sum(positive) for p in positive])
    stack, blend = rows["Stacking Ensemble"], rows["Weighted Ensemble"]
    chosen = {r.model for r in rows.values() if r.chosen}
    assert chosen == {"Stacking Ensemble" if stack.r2 > blend.r2 else "Weighted Ensemble"}
    best = rows[chosen.pop()]
    ridge = rows["Ridge Regression"]
    assert ridge.r2_improvement_pct == pytest.approx((best.r2 - ridge.r2) / (abs(ridge.r2) + 1e-10) * 100)
    assert len({r.n for r in rows.values()}) == 1


def test_selected_models_stacking_horizons_and_scores(spark):
    sel = query(spark, "selected_feature_models").collect()
    assert len(sel) == 6 and len({r.variant for r in sel}) == 1
    st = query(spark, "stacking").first()
    assert st.r2 <= 1 and st.n == L.prepared(spark, FEW["sf"]).test.count()
    hz = {r.horizon: r for r in query(spark, "multi_horizon").collect()}
    assert set(hz) == {"next_day", "next_week"} and all(r.r2 <= 1 and r.rmse >= r.mae for r in hz.values())
    sc = query(spark, "stream_score").collect()
    assert sum(r.n for r in sc) == L.prepared(spark, FEW["sf"]).test.count()


def test_feature_columns_and_findings(spark):
    f = query(spark, "feature_columns").collect()
    assert {r.feature for r in f} == set(L.prepared(spark, FEW["sf"]).feature_names)
    assert {r.category for r in f} <= {"lag", "rolling", "trend", "short_term", "medium_term", "long_term", "context"}
    found = query(spark, "findings_table").collect()
    weather = query(spark, "weather_stats").count()
    assert sum(r.section == "weather" for r in found) == weather and sum(r.section == "weekday" for r in found) == 1
    assert all(r.line for r in found)


def test_a_changed_table_is_prepared_anew(spark, tmp_path):
    import shutil
    folder = tmp_path / "sf"
    folder.mkdir()
    shutil.copy(f"{SF_SMALL}/lineitem.parquet", folder / "lineitem.parquet")
    first = L.prepared(spark, str(folder))
    assert L.prepared(spark, str(folder)) is first
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").where(F.col("l_suppkey") % 16 < 12).coalesce(1) \
        .write.parquet(str(tmp_path / "less"))
    part = next((tmp_path / "less").glob("part-*.parquet"))
    shutil.copy(part, folder / "lineitem.parquet")
    spark.catalog.refreshByPath(str(folder / "lineitem.parquet"))
    assert L.prepared(spark, str(folder)) is not first


def test_registered_fits_have_the_references_sizes():
    made = []
    for sizes in (L.QUERY_SIZES, L.STACK_SIZES, L.IMPORTANCE_SIZES):
        for name in (*FT.TREES, "Gradient Boosting"):
            s = FT.tree_spec(name, sizes)
            made.append((s.steps, s.rate, s.max_depth) if name == "Gradient Boosting" else
                        (s.trees, s.max_depth, s.bootstrap, s.random))
    boost = (300, 0.05, 5)
    assert made == [(1, 15, False, False), (200, 20, True, False), (200, 20, False, True), boost,
                    (1, 12, False, False), (100, 15, True, False), (100, 15, False, True), boost,
                    (1, 15, False, False), (100, None, True, False), (200, 20, False, True), boost]
