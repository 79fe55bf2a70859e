"""Trees, forests and boosting against brute force, and both phases against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanespark.operators import trees as T


def slow_tree(x, y, w, depth, most, least):
    """Exact best-split tree by trying every cut (x: features by rows)."""
    n = len(y)
    value = (w * y).sum() / w.sum()
    if n < 2 or (most is not None and depth >= most) or np.ptp(y) < 1e-9:
        return value
    best = None
    for f in range(len(x)):
        order = np.argsort(x[f], kind="stable")
        for i in range(least - 1, n - least):
            if x[f][order[i + 1]] > x[f][order[i]] + T.SAME:
                gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (order[:i + 1], order[i + 1:]))
                if best is None or gain > best[0] * (1 + 1e-10):
                    best = (gain, f, float(x[f][order[i]]) / 2 + float(x[f][order[i + 1]]) / 2)
    if best is None:
        return value
    _, f, t = best
    left = x[f] <= t
    return f, t, *(slow_tree(x[:, s], y[s], w[s], depth + 1, most, least) for s in (left, ~left))


def slow_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def table(spark):
    """200 training rows in folds 1 to 4 and 60 others (fold 0), 5 features, some with ties."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 5))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), rng.integers(0, 2, 260)
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + x[:, 3] + rng.normal(scale=0.3, size=260) + 50
    fold = np.where(np.arange(260) < 200, np.arange(260) % 4 + 1, 0)
    df = spark.createDataFrame([(i, int(f), float(t), [float(v) for v in r]) for i, (r, t, f) in enumerate(zip(x, y, fold))],
                               "row_id long, fold int, label double, x array<double>").repartition(4)
    return T.matrix(df), x.astype(np.float32).T.copy(), y, fold


def scores(df, spec=0):
    return {r.id: r.value for r in df.where(F.col("kind") == "score").collect() if r.spec == spec}


@pytest.mark.parametrize("most, least", [(None, 1), (4, 1), (20, 3)])
def test_a_forest_is_the_mean_of_exact_trees(table, most, least):
    rows, x, y, fold = table
    spec = T.Forest("forest", trees=3, max_depth=most, min_leaf=least, bootstrap=True)
    got = scores(T.forests(rows, [spec]))
    train = fold > 0
    want = np.zeros(len(y))
    for t in range(3):
        w = T.bootstrap_weights(np.arange(len(y)), spec.seed, t) * train
        use = w > 0
        tree = slow_tree(x[:, use], y[use] - y.mean(), w[use], 0, most, least)
        want += [slow_predict(tree, r) + y.mean() for r in x.T]
    assert got.keys() == set(range(260))
    assert np.allclose([got[i] for i in range(260)], want / 3, atol=1e-8)


def test_bootstrap_weights_are_poisson():
    w = np.concatenate([T.bootstrap_weights(np.arange(20_000), 1, t) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_a_tree_of_one_fold_predicts_that_fold(table):
    rows, x, y, fold = table
    got = scores(T.forests(rows, [T.Forest("other"), T.Forest("tree", fold=2)]), 1)
    assert set(got) == set(np.nonzero(fold == 2)[0])
    use = (fold > 0) & (fold != 2)
    tree = slow_tree(x[:, use], y[use] - 50, np.ones(use.sum()), 0, None, 1)
    assert np.allclose([got[i] for i in sorted(got)], [slow_predict(tree, x[:, i]) + 50 for i in sorted(got)])


def test_random_thresholds_are_uniform_and_of_no_bin():
    """Root thresholds of many trees on one feature: uniform over the node's range, all different."""
    x = np.random.default_rng(0).exponential(size=(1, 300)).astype(np.float32)
    y = np.random.default_rng(1).normal(size=300)
    spec = T.Forest("random", trees=2000, random=True, max_depth=1)
    cuts = np.array([T.grow(x, y, np.ones(300), None, T.root_key(5, t), 0, spec).threshold[0] for t in range(2000)])
    u = np.sort((cuts - x.min()) / (x.max() - x.min()))
    assert len(np.unique(cuts)) == 2000
    assert np.abs(u - (np.arange(2000) + 0.5) / 2000).max() < 1.63 / np.sqrt(2000)     # Kolmogorov-Smirnov at 1 %


def test_random_trees_fit_their_rows_and_use_the_best_feature(table):
    rows, x, y, fold = table
    df = T.forests(rows, [T.Forest("extra", trees=5, random=True)])
    got = scores(df)
    assert np.allclose([got[i] for i in range(200)], y[:200])              # grown to the leaves, no bootstrap
    gain = {r.id: r.value for r in df.where("kind = 'gain'").collect()}
    assert sum(gain.values()) == pytest.approx(1.0) and max(gain, key=gain.get) == 0


def test_gains_are_shares_of_the_exact_falls(table):
    rows, x, y, fold = table
    got = {r.id: r.value for r in T.forests(rows, [T.Forest("tree", max_depth=1)]).where("kind = 'gain'").collect()}
    tree = slow_tree(x[:, :200], y[:200], np.ones(200), 0, 1, 1)
    assert got == {f: float(f == tree[0]) for f in range(5)}


def test_depth_curve_equals_separate_trees(table):
    rows, x, y, fold = table
    df = T.forests(rows, [T.Forest("curve", fold=3, depths=(1, 2, 5, 30))])
    got = {(r.kind, r.id): r.value for r in df.where("kind like '%error'").collect()}
    train, held = (fold > 0) & (fold != 3), fold == 3
    for d in (1, 2, 5, 30):
        one = scores(T.forests(rows, [T.Forest("one", max_depth=d, fold=3)]))
        assert got["held error", d] == pytest.approx(sum((y[i] - v) ** 2 for i, v in one.items()))
        tree = slow_tree(x[:, train], y[train] - 50, np.ones(train.sum()), 0, d, 1)
        said = np.array([slow_predict(tree, r) + 50 for r in x[:, train].T])
        assert got["train error", d] == pytest.approx(((y[train] - said) ** 2).sum(), abs=1e-9)
    assert len(got) == 8


def test_both_phases_grow_the_same_trees(table):
    """With few distinct values the histograms' splits are the exact ones, so cutting at any size changes nothing."""
    rows, x, y, fold = table
    coarse = rows.sparkSession.createDataFrame(
        [(i, int(f), float(np.round(t, 2)), [float(v) for v in np.round(r * 4) / 4]) for i, (r, t, f) in enumerate(zip(x.T, y, fold))],
        "row_id long, fold int, label double, x array<double>").repartition(3)
    m = T.matrix(coarse)
    specs = [T.Forest("forest", trees=2, bootstrap=True), T.Forest("extra", trees=2, random=True, max_depth=6),
             T.Forest("curve", fold=1, depths=(1, 3, 8)), T.Forest("few", trees=2, max_features=2)]
    one, two = ({(r.spec, r.kind, r.id): r.value for r in T.forests(m, specs, cells).collect()} for cells in (10 ** 6, 200))
    assert one.keys() == two.keys()
    # the first phase cuts at the value itself, the second in the middle: only rows that train a tree must fall alike
    same = [k for k in one if k[1] in ("gain", "train error") or k[1] == "score" and k[0] in (1, 3) and fold[k[2]] > 0]
    assert len(same) > 400 and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in same)


def test_kept_trees_predict_what_they_said(table):
    rows, x, y, fold = table
    specs = [T.Forest("forest", trees=4, max_depth=6, bootstrap=True), T.Forest("extra", trees=3, random=True)]
    for cells in (10 ** 6, 300):
        grown = T.fit(rows, specs, cells)
        assert grown.trees.count() >= 7
        got = {(r.spec, r.row_id): r.prediction for r in grown.predict(rows.where("fold = 0")).collect()}
        said = {(r.spec, r.id): r.value for r in T.forests(rows, specs, cells).where("kind = 'score'").collect()}
        assert len(got) == 120 and all(got[k] == pytest.approx(said[k]) for k in got)


def test_boosting_in_one_task_and_by_jobs_is_the_same(table):
    rows, x, y, fold = table
    specs = [T.Booster("all", steps=12, rate=0.3, max_depth=3), T.Booster("fold", steps=12, rate=0.3, max_depth=3, fold=2),
             T.Booster("part", steps=5, rate=0.5, max_depth=2, subsample=0.6, min_leaf=4)]
    one, two = ({(r.spec, r.kind, r.id): r.value for r in T.boosters(rows, specs, cells).collect()}
                for cells in (10 ** 6, 10))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-6) for k in one)
    loss = [one[0, "loss", i] for i in range(1, 13)]
    assert all(b < a for a, b in zip(loss, loss[1:]))
    said = np.array([one[0, "score", i] for i in range(200)])
    assert loss[-1] == pytest.approx(((y[:200] - said) ** 2).mean())
    assert {k[2] for k in one if k[:2] == (1, "score")} == set(np.nonzero(fold == 2)[0])


def test_boosting_steps_are_exact_trees_of_residuals(spark):
    """Few distinct values: every step is the exact tree of the residuals."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, (150, 3)).astype(np.float32)
    y = x[:, 0] * 1.5 + (x[:, 1] > 7) * 4 + rng.normal(size=150)
    df = spark.createDataFrame([(i, 1, float(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y))],
                               "row_id long, fold int, label double, x array<double>")
    got = {(r.kind, r.id): r.value for r in T.boosters(T.matrix(df), [T.Booster("b", 6, 0.3, 3)]).collect()}
    said = np.full(150, y.mean())
    for step in range(6):
        tree = slow_tree(x.T, y - said, np.ones(150), 0, 3, 1)
        said = said + 0.3 * np.array([slow_predict(tree, r) for r in x])
        assert got["loss", step + 1] == pytest.approx(((y - said) ** 2).mean(), rel=1e-9)
    assert np.allclose([got["score", i] for i in range(150)], said)


def test_empty_tables_grow_nothing(spark, table):
    none = table[0].where("row_id < 0")
    assert T.forests(none, [T.Forest("f")]).count() == 0 and T.boosters(none, [T.Booster("b")]).count() == 0
