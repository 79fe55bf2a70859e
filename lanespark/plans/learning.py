"""Model queries (rows-only checks; parity tests live in tests/).

The prepared training set is built once per (session, table, leakage mode)
and reused by every model query (checkpointed, like the reference's session
state), and so is every fit (``operators.fits``). The registered queries fit
the reference's full sizes (``REFERENCE_SIZES``; the stacking bases
``STACK_SIZES``).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_rnd
from ..operators import fits as FT
from ..operators import information as IN
from ..operators import metrics as MT
from ..operators import models as ML
from ..operators import neighbors as NB
from ..operators import online as ON
from ..operators import selection as S
from ..operators import split as SP
from ..operators import trees as T
from ..operators.ordering import global_row_number
from ..session import cut_lineage
from ..sources import bindings as B
from .features import _SPLIT_CTE, WX
from .registry import register

CATEGORIES = ["Clear", "Fog", "Overcast", "Rain", "Windy"]

# ---- fixed values that must equal the reference's ---------------------------
REFERENCE_SIZES = dict(ridge_alpha=0.001, lasso_alpha=0.01, enet_alpha=0.01, enet_l1=0.5, knn_k=8,
                       knn_weights="distance", tree_depth=15, rf_trees=200, rf_depth=20, et_trees=200, et_depth=20,
                       gb_iter=300, gb_lr=0.05, gb_depth=5, stack_meta_alpha=1.0, cv_folds=5,
                       window_sizes=[100, 200, 500], selection_ratio=0.7, mi_neighbors=5)
# the reference's stacking bases and importance forest have sizes of their own; the latter's trees grow without a limit
STACK_SIZES = dict(REFERENCE_SIZES, tree_depth=12, rf_trees=100, rf_depth=15, et_trees=100, et_depth=15)
IMPORTANCE_SIZES = dict(REFERENCE_SIZES, rf_trees=100, rf_depth=None)
# the variants that the reference compares, family by family
VARIANTS = {"Linear Regression": [("default", {})],
            "Ridge Regression": [(f"alpha={a}", dict(ridge_alpha=a)) for a in (0.1, 1.0, 10.0)],
            "Lasso Regression": [(f"alpha={a}", dict(lasso_alpha=a)) for a in (0.001, 0.01, 0.1, 1.0)],
            "ElasticNet": [(f"alpha={a}", dict(enet_alpha=a, enet_l1=0.5)) for a in (0.001, 0.01, 0.1)],
            "KNN": [(f"k={k}", dict(knn_k=k, knn_weights="uniform")) for k in (3, 5, 11)],
            "Decision Tree": [(f"max_depth={d}", dict(tree_depth=d)) for d in (6, 12, None)],
            "Random Forest": [(f"{n} trees", dict(rf_trees=n, rf_depth=None)) for n in (50, 100, 200)],
            "Extra Trees": [(f"{n} trees", dict(et_trees=n, et_depth=None)) for n in (50, 100, 200)],
            "Gradient Boosting": [(f"{n} estimators, lr=0.1", dict(gb_iter=n, gb_lr=0.1, gb_depth=5)) for n in (100, 200)]}
CURVE_DEPTHS = tuple(range(2, 25))
# -----------------------------------------------------------------------------
QUERY_SIZES = REFERENCE_SIZES
VARIANT_NAMES = {"Linear Regression": "default", "Ridge Regression": "alpha=0.001", "Lasso Regression": "alpha=0.01",
                 "ElasticNet": "alpha=0.01, l1_ratio=0.5", "KNN": "k=8, distance", "Decision Tree": "max_depth=15",
                 "Random Forest": "trees=200, max_depth=20", "Extra Trees": "trees=200, max_depth=20",
                 "Gradient Boosting": "iter=300, lr=0.05, depth=5"}

_PREP: dict = {}


def prepared(spark, sf, leakage="parity") -> ML.Prepared:
    """The training set, kept for as long as the source's files stay the same."""
    slot = (spark.sparkContext.applicationId, sf, leakage)
    version = B.version(spark, sf, "lineitem")
    if slot not in _PREP or _PREP[slot][0] != version:
        _PREP[slot] = (version, ML.prepare_features(B.daily_traffic(spark, sf), CATEGORIES, leakage=leakage))
    return _PREP[slot][1]


def fits(spark, sf, leakage="parity") -> FT.Fits:
    return FT.of(prepared(spark, sf, leakage))


def _variant(key, name):
    @register(key)
    def q(spark, sf):
        return fits(spark, sf).evaluate([(name, VARIANT_NAMES[name], QUERY_SIZES)])
    q.__doc__ = f"{name}: fit, time and train/test metrics (one row)."
    return q


_variant("linear_regression", "Linear Regression")      # ML-01
_variant("ridge", "Ridge Regression")                    # ML-02
_variant("lasso", "Lasso Regression")                    # ML-03
_variant("elastic_net", "ElasticNet")                    # ML-04
_variant("knn_regression", "KNN")                        # ML-05 on the scaled training columns
_variant("decision_tree", "Decision Tree")               # ML-06
_variant("random_forest", "Random Forest")               # ML-07
_variant("extra_trees", "Extra Trees")                   # ML-08
_variant("gradient_boosting", "Gradient Boosting")       # ML-09


@register("ridge_safe")
def q_ridge_safe(spark, sf):
    """ML-02 on the leakage-safe feature table (the target is not recoverable: R2 < 1)."""
    return fits(spark, sf, "safe").evaluate([("Ridge Regression", "alpha=0.001, safe", QUERY_SIZES)])


@register("boosting_curve")
def q_boosting_curve(spark, sf):
    """ML-10: training loss after every step of the one boosting fit."""
    sums = fits(spark, sf).full("Gradient Boosting", QUERY_SIZES).sums
    return sums.where("kind = 'loss'").select(F.col("id").cast("int").alias("iteration"), F.col("value").alias("loss"))


@register("coefficient_table")
def q_coefficient_table(spark, sf):
    """FP-12: ridge coefficients sorted by magnitude."""
    prep = prepared(spark, sf)
    model = fits(spark, sf).estimator("Ridge Regression", QUERY_SIZES).fit(prep.train)
    return ML.coefficient_table(spark, model, prep.feature_names)


@register("lasso_eliminated")
def q_lasso_eliminated(spark, sf):
    """FP-11: features whose lasso coefficient is exactly zero, with the kept count."""
    prep = prepared(spark, sf)
    model = fits(spark, sf).estimator("Lasso Regression", QUERY_SIZES).fit(prep.train)
    c = ML.coefficient_table(spark, model, prep.feature_names)
    kept = c.agg(F.count_if(F.col("coefficient") != 0).alias("n_kept"))
    return c.where(F.col("coefficient") == 0).select("feature").crossJoin(kept)


def _importance(prep) -> DataFrame:
    sums = FT.of(prep).full("Random Forest", IMPORTANCE_SIZES).sums
    name = F.element_at(F.array(*[F.lit(n) for n in prep.feature_names]), F.col("id").cast("int") + 1)
    return sums.where("kind = 'gain'").select(name.alias("feature"), F.col("value").alias("importance"))


@register("rf_importance")
def q_rf_importance(spark, sf):
    """FP-09: impurity importances of 100 trees that grow without a limit."""
    return _importance(prepared(spark, sf))


def _fold_rows(prep):
    """Training rows with WN-15 contiguous folds (row order = split order) and their scaled columns ``x``."""
    return FT.of(prep).rows().where("fold > 0")


@register("validation_curve")
def q_validation_curve(spark, sf):
    """ML-13: ridge train / CV R2 for a grid of alphas from per-fold Gram statistics (one data pass)."""
    prep = prepared(spark, sf)
    stats = FT.of(prep).grams()
    alphas = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
    res = ON.ridge_path(stats, alphas)
    df = spark.createDataFrame(res, "alpha double, fold int, train_r2 double, cv_r2 double")
    g = df.groupBy("alpha").agg(F.avg("train_r2").alias("train_r2"), F.avg("cv_r2").alias("cv_r2"),
                                F.stddev_pop("cv_r2").alias("cv_std"))
    best = g.agg(F.max_by("alpha", "cv_r2").alias("_best"))
    return g.crossJoin(best).withColumn("is_best", F.col("alpha") == F.col("_best")).drop("_best")


def _all_families(names=FT.FAMILIES):
    return [(n, QUERY_SIZES) for n in names]


@register("cross_validate")
def q_cross_validate(spark, sf):
    """ML-12: 5 contiguous folds, mean and population std of the fold R2, for every family."""
    return fits(spark, sf).cv(_all_families())


@register("evaluate_variant")
def q_evaluate_variant(spark, sf):
    """ML-11: every family's row: train and test metrics, gap, status, time, CV R2."""
    f = fits(spark, sf)
    rows = f.evaluate([(n, VARIANT_NAMES[n], QUERY_SIZES) for n in FT.FAMILIES])
    return rows.join(f.cv(_all_families()).select("model", "cv_r2", "cv_std"), "model", "left")


def variant_grid(spark, sf):
    """Not registered (25 variants with their fold fits take many minutes): ML-11 over the variants that are compared in training: 25 rows with train, test and CV metrics.

    Smaller forests are the first trees of the largest, shorter boostings its first steps: each kind is fitted once."""
    f = fits(spark, sf)
    wanted = [(n, v, {**QUERY_SIZES, **z}) for n, variants in VARIANTS.items() for v, z in variants]
    sizes = {"Random Forest": "rf_trees", "Extra Trees": "et_trees", "Gradient Boosting": "gb_iter"}
    prefixes = {n: tuple(z[s] for _, z in VARIANTS[n][:-1]) for n, s in sizes.items()}
    largest = {n: {**QUERY_SIZES, **VARIANTS[n][-1][1]} for n in sizes}
    f.grow([(n, largest[n], FT.tree_spec(n, largest[n], prefixes=prefixes[n])) for n in sizes])
    f.held([(n, largest[n]) for n in sizes], prefixes)
    rows = f.evaluate(wanted)
    cv = f.cv([(n, z) for n, _, z in wanted], [f"{n}/{v}" for n, v, _ in wanted])
    return rows.join(cv.select(F.split("model", "/")[0].alias("model"), F.split("model", "/")[1].alias("variant"),
                               "cv_r2", "cv_std"), ["model", "variant"], "left")


@register("depth_curve")
def q_depth_curve(spark, sf):
    """ML-13 for trees: train and CV R2 of every depth from 2 to 24, from one deep tree a fold, and the best depth."""
    f = fits(spark, sf)
    specs = [T.Forest(f"depth {k}", max_depth=max(CURVE_DEPTHS), fold=k, depths=CURVE_DEPTHS) for k in range(1, f.folds + 1)]
    sums = T.forests(f.matrix(), specs).where(F.col("kind").endswith("error"))
    labels = f.labels().where("fold > 0")
    whole = [labels.where(F.col("fold") == k if held else F.col("fold") != k).agg(
        F.lit(k - 1).alias("spec"), F.lit(kind).alias("kind"), (F.var_pop("label") * F.count("*")).alias("sst"))
        for k in range(1, f.folds + 1) for kind, held in (("train error", False), ("held error", True))]
    sst = whole[0]
    for w in whole[1:]:
        sst = sst.unionByName(w)
    r2 = sums.join(F.broadcast(sst), ["spec", "kind"]).select(    # two rows a fold
        F.col("id").cast("int").alias("max_depth"), "kind", (F.lit(1.0) - F.try_divide("value", "sst")).alias("r2"))
    side = lambda k: F.when(F.col("kind") == k, F.col("r2"))
    g = r2.groupBy("max_depth").agg(
        F.avg(side("train error")).alias("train_r2"), F.stddev_pop(side("train error")).alias("train_std"),
        F.avg(side("held error")).alias("cv_r2"), F.stddev_pop(side("held error")).alias("cv_std"))
    best = Window.orderBy(F.desc("cv_r2"), "max_depth")      # one row a depth
    return g.withColumn("is_best", F.row_number().over(best) == 1)


def _windows(spark, sf, leakage="parity"):
    """Per-block static/online R2 for every window size, kept with the training set it was computed from."""
    prep = prepared(spark, sf, leakage)
    if "windows" not in prep.stats:
        prep.stats["windows"] = _compute_windows(spark, sf, leakage)
    return prep.stats["windows"]


def _compute_windows(spark, sf, leakage):
    prep = prepared(spark, sf, leakage)
    p = len(prep.feature_names)
    train = ML.features_array(prep.train)
    test = prep.test.select("row_id", "traffic_date", "road_name", "label",
                            vector_to_array("features_scaled").alias("x"))
    res = ON.online_adaptation(train, test, ["traffic_date", "road_name"], "x", "label", p,
                               REFERENCE_SIZES["window_sizes"], REFERENCE_SIZES["ridge_alpha"])
    return cut_lineage(res)  # a few hundred rows; re-read by the summary queries


@register("online_windows")
def q_online_windows(spark, sf):
    """ON-01/02: static vs online ridge R2 per block of 100/200/500 test rows (Gram statistics)."""
    return _windows(spark, sf).select("window_size", "block", "static_r2", "online_r2")


@register("window_summary")
def q_window_summary(spark, sf):
    """AG-42 + ON-03: mean static/online R2 per window size and the adaptation gain."""
    w = _windows(spark, sf)
    g = w.groupBy("window_size").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("static_r2").alias("avg_static_r2"),
                                     F.avg("online_r2").alias("avg_online_r2"))
    return g.withColumn("improvement_pct", MT.adaptation_gain(F.col("avg_static_r2"), F.col("avg_online_r2")))


# ---- nearest neighbours on the embeddings table -------------------------------------
# Queries: vec_id % 10 < 3; base: the rest. Distances in double.
def _emb(spark, sf):
    e = B.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lit(None).cast("long").alias("grp"))
    return e.where(F.col("vec_id") % 10 >= 3), e.where(F.col("vec_id") % 10 < 3)


def _neighbours(spark, sf, k):
    train, test = _emb(spark, sf)
    found = NB.nearest(test.withColumnRenamed("vec_id", "query_id"), train.withColumnRenamed("vec_id", "neighbor_id"), k)
    return found, train, test


def _nearest_sql(k: int, body: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, q.label AS actual, b.vec_id AS neighbor_id, b.label,
             list_distance(q.v, b.v) AS distance
      FROM e q JOIN e b ON q.vec_id % 10 < 3 AND b.vec_id % 10 >= 3),
nn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank
                      FROM d) WHERE rank <= {k})
{body}"""


@register("knn_candidates", _nearest_sql(30, f"SELECT query_id, neighbor_id, {sql_rnd('distance', 8)} AS distance FROM nn"))
def q_knn_candidates(spark, sf):
    """JN-09: the 30 nearest training vectors of every test vector, found through cells and distance bounds."""
    nb, _, _ = _neighbours(spark, sf, 30)
    return nb.select("query_id", "neighbor_id", rnd("distance", 8).alias("distance"))


@register("topk_per_group", _nearest_sql(8, f"SELECT query_id, neighbor_id, {sql_rnd('distance', 8)} AS distance, rank FROM nn"))
def q_topk_per_group(spark, sf):
    """SL-08: the 8 nearest training vectors of every test vector."""
    nb, _, _ = _neighbours(spark, sf, 8)
    return nb.select("query_id", "neighbor_id", rnd("distance", 8).alias("distance"), "rank")


@register("knn", _nearest_sql(8, f"""
, p AS (SELECT query_id, max(actual) AS actual, CASE WHEN count_if(distance = 0) > 0
               THEN avg(label) FILTER (WHERE distance = 0) ELSE sum(label / distance) / sum(1.0e0 / distance) END AS pred
        FROM nn GROUP BY 1)
SELECT count(*) AS n, {sql_rnd('1.0e0 - sum((actual - pred) * (actual - pred)) / nullif(var_pop(actual) * count(*), 0)', 6)} AS r2,
       {sql_rnd('sqrt(sum((actual - pred) * (actual - pred)) / count(*))', 6)} AS rmse,
       {sql_rnd('avg(abs(actual - pred))', 6)} AS mae FROM p"""))
def q_knn(spark, sf):
    """ML-05: k=8 distance-weighted neighbour regression of the label, with metrics."""
    nb, train, test = _neighbours(spark, sf, 8)
    pred = NB.knn_predict(nb, train, "vec_id", "label", "distance")
    t = pred.join(test.select(F.col("vec_id").alias("query_id"), F.col("label").alias("actual")), "query_id")
    m = MT.regression_metrics(t, "actual", "prediction")
    return m.select("n", *[rnd(c, 6).alias(c) for c in ("r2", "rmse", "mae")])


@register("elbow_k", f"""
WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS v,
                  ntile(5) OVER (ORDER BY vec_id) AS fold FROM embeddings WHERE vec_id % 10 >= 3),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM (
         SELECT q.vec_id AS query_id, q.label AS actual, q.fold, b.vec_id AS neighbor_id, b.label,
                list_distance(q.v, b.v) AS distance FROM e q JOIN e b ON q.fold <> b.fold)),
r AS (SELECT fold, rank AS k, actual, avg(label) OVER (PARTITION BY query_id ORDER BY rank
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pred FROM nn WHERE rank <= 30),
f AS (SELECT k, fold, 1.0e0 - sum((actual - pred) * (actual - pred)) / nullif(var_pop(actual) * count(*), 0) AS r2
      FROM r GROUP BY 1, 2),
g AS (SELECT k, avg(r2) AS cv_r2 FROM f GROUP BY 1)
SELECT CAST(k AS INT) AS k, {sql_rnd('cv_r2', 6)} AS cv_r2, row_number() OVER (ORDER BY cv_r2 DESC, k) = 1 AS is_best FROM g""")
def q_elbow_k(spark, sf):
    """ML-14: 5-fold cross-validated R2 for k = 1..30 on the training vectors, and the best k."""
    train, _ = _emb(spark, sf)
    numbered = global_row_number(train, ["vec_id"], "_k", total="_n")
    rows = numbered.select("vec_id", "label", "v",
                           SP.contiguous_folds(F.col("_k"), F.col("_n"), 5).cast("long").alias("grp"))
    nb = NB.nearest(rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "neighbor_id"), 30)
    curve = NB.elbow_curve(nb, rows.select(F.col("vec_id").alias("id"), F.col("grp").alias("fold"), "label"), 30)
    return curve.select("k", rnd("cv_r2", 6).alias("cv_r2"), "is_best")


# ---- multi-horizon, selection-driven refit, ensembles -------------------------------
@register("multi_horizon")
def q_multi_horizon(spark, sf):
    """CM-06: next-day and next-week targets (lead 1 / lead 7 rows per road), ridge on calendar+lags."""
    d = B.daily_traffic(spark, sf)
    w = Window.partitionBy("road_name").orderBy("traffic_date", "road_name")
    base = d.select("traffic_date", "road_name", "volume", "avg_speed", "congestion",
                    F.weekday("traffic_date").alias("dow"), F.month("traffic_date").alias("month"),
                    F.lag("volume", 1).over(w).alias("lag1"), F.lag("volume", 7).over(w).alias("lag7"),
                    F.lead("volume", 1).over(w).alias("next_day"), F.lead("volume", 7).over(w).alias("next_week"))
    from pyspark.ml.feature import VectorAssembler
    feats = ["volume", "avg_speed", "congestion", "dow", "month", "lag1", "lag7"]
    rows = []
    for horizon in ("next_day", "next_week"):
        h = base.where(F.col(horizon).isNotNull() & F.col("lag7").isNotNull()) \
            .select(*[F.col(c).cast("double") for c in feats], F.col(horizon).cast("double").alias("label"),
                    "traffic_date", "road_name")
        h = VectorAssembler(inputCols=feats, outputCol="features").transform(h) \
            .withColumn("_h", ML.split_key_daily())
        sp = SP.train_test_split(h, ["_h", "traffic_date", "road_name"], 0.3)
        tr, te = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
        sd = tr.agg(F.stddev_pop("label")).first()[0]
        n = tr.count()
        model = ML.ridge(1.0, sd, n, features="features").fit(tr)
        m = MT.regression_metrics(model.transform(te), "label", "prediction").withColumn("horizon", F.lit(horizon))
        rows.append(m)
    return rows[0].unionByName(rows[1])


def _mi(spark, sf) -> DataFrame:
    """kNN mutual information of every training column with the target, kept with the training set."""
    prep = prepared(spark, sf)
    if "mi" not in prep.stats:
        rows = FT.of(prep).rows().where("fold > 0").select("row_id", "label", "x")
        prep.stats["mi"] = cut_lineage(IN.knn_mutual_information(rows, prep.feature_names, REFERENCE_SIZES["mi_neighbors"]))
    return prep.stats["mi"]


@register("mutual_information_knn")
def q_mutual_information_knn(spark, sf):
    """FP-08: mutual information of the 61 training columns with the target by 5 nearest neighbours."""
    return _mi(spark, sf)


@register("feature_selection")
def q_feature_selection(spark, sf):
    """FP-10 on the training rows: kNN mutual information and forest importance, their ranks, the selected columns."""
    imp = _importance(prepared(spark, sf)).withColumnRenamed("importance", "rf_importance")
    return S.adaptive_selection(_mi(spark, sf).join(imp, "feature"))


def _selected(spark, sf) -> ML.Prepared:
    """The training set on the selected columns, kept with it."""
    from pyspark.ml.feature import VectorSlicer
    prep = prepared(spark, sf)
    if "selected" not in prep.stats:
        names = prep.feature_names
        chosen = [r["feature"] for r in q_feature_selection(spark, sf).where("selected")
                  .select("feature", "combined_rank").orderBy("combined_rank").collect()]  # <= p names
        idx = [names.index(c) for c in chosen]

        def slice_(d):
            for c in ("features", "features_scaled"):
                d = VectorSlicer(inputCol=c, outputCol="_s", indices=idx).transform(d).drop(c).withColumnRenamed("_s", c)
            return d
        prep.stats["selected"] = ML.Prepared(slice_(prep.train), slice_(prep.test), chosen)
    return prep.stats["selected"]


_SELECTED_FAMILIES = ["Linear Regression", "Ridge Regression", "Decision Tree", "Random Forest",
                      "Extra Trees", "Gradient Boosting"]


@register("selected_feature_models")
def q_selected_feature_models(spark, sf):
    """ML-15 (+ FP-10 on real scores): six families refitted on the selected features, one row each."""
    sub = _selected(spark, sf)
    rows = FT.of(sub).evaluate([(n, f"{len(sub.feature_names)} features", QUERY_SIZES) for n in _SELECTED_FAMILIES])
    return rows.withColumn("model", F.concat("model", F.lit(" (selected)")))


_STACK_BASES = ["Ridge Regression", "Random Forest", "Gradient Boosting", "Extra Trees", "Decision Tree"]


def _bases(f: FT.Fits):
    """The bases' predictions of training rows (by the other folds) and of all rows (by all), one column each."""
    held = f.held([(n, STACK_SIZES) for n in _STACK_BASES])
    oof = f.wide({f"b{i}": d for i, d in enumerate(held.values())})
    f.grow([(n, STACK_SIZES, FT.tree_spec(n, STACK_SIZES)) for n in _STACK_BASES[1:]
            if FT._key(n, STACK_SIZES) not in f._full])
    every = f.wide({f"b{i}": f.full(n, STACK_SIZES).scores for i, n in enumerate(_STACK_BASES)})
    return cut_lineage(oof), cut_lineage(every)


def _mixed(weights, columns):
    """Weighted sum of columns; a last weight without a column is added."""
    out = F.lit(float(weights[len(columns)])) if len(weights) > len(columns) else F.lit(0.0)
    for w, c in zip(weights, columns):
        out = out + F.lit(float(w)) * F.col(c)
    return out


_BASE_COLUMNS = [f"b{i}" for i in range(len(_STACK_BASES))]


@register("stacking")
def q_stacking(spark, sf):
    """EN-01: out-of-fold predictions of 5 bases -> Ridge(1.0) meta; bases refitted on all training rows."""
    f = fits(spark, sf)
    oof, every = _bases(f)
    w = f.stack_weights(oof, _BASE_COLUMNS, REFERENCE_SIZES["stack_meta_alpha"])
    out = every.where("fold = 0").withColumn("stacked", _mixed(w, _BASE_COLUMNS))
    return MT.regression_metrics(out, "label", "stacked").withColumn("model", F.lit("Stacking Ensemble"))


@register("prepare_features", WX(_SPLIT_CTE + """
SELECT (SELECT count(*) FROM daily_traffic) AS n_original, count(*) AS n_clean,
       CAST(count_if(NOT is_test) AS BIGINT) AS n_train, CAST(count_if(is_test) AS BIGINT) AS n_test,
       CAST(61 AS INT) AS n_features FROM sp"""))
def q_prepare_features(spark, sf):
    """FP-06: sizes before/after cleaning and of the split, and the feature count."""
    prep = prepared(spark, sf)
    d = B.daily_traffic(spark, sf).agg(F.count(F.lit(1)).alias("n_original"))
    tr = prep.train.agg(F.count(F.lit(1)).alias("n_train"))
    te = prep.test.agg(F.count(F.lit(1)).alias("n_test"))
    return d.crossJoin(tr).crossJoin(te).select(
        "n_original", (F.col("n_train") + F.col("n_test")).alias("n_clean"), "n_train", "n_test",
        F.lit(len(prep.feature_names)).alias("n_features"))


@register("static_windows")
def q_static_windows(spark, sf):
    """ON-01: the static ridge's R2 on every block of 100/200/500 test rows."""
    return _windows(spark, sf).select("window_size", "block", "static_r2")


@register("adaptation_gain")
def q_adaptation_gain(spark, sf):
    """ON-03: (online - static) / (|static| + 1e-10) * 100 per window size (and the |static + 1e-10| form)."""
    g = _windows(spark, sf).groupBy("window_size").agg(F.avg("static_r2").alias("s"), F.avg("online_r2").alias("o"))
    return g.select("window_size", MT.adaptation_gain(F.col("s"), F.col("o")).alias("gain_pct"),
                    MT.adaptation_gain(F.col("s"), F.col("o"), abs_of_sum=True).alias("gain_pct_alt"))


def _test_blocks(spark, sf, ws):
    prep = prepared(spark, sf)
    test = prep.test.select("row_id", "traffic_date", "road_name", "label")
    return prep, SP.row_blocks(test, ["traffic_date", "road_name"], ws)


_PREFIX_SQL = """,
te AS (SELECT volume, row_number() OVER (ORDER BY traffic_date, road_name) AS k, count(*) OVER () AS n
       FROM sp WHERE is_test),
bl AS (SELECT CAST(floor((k - 1) / 100) + 1 AS INT) AS block, count(*) AS block_rows, sum(volume) AS s FROM te
       WHERE n // 100 >= 2 AND k <= (n // 100) * 100 GROUP BY 1),
tr AS (SELECT count(*) AS nt, sum(volume) AS st FROM sp WHERE NOT is_test),
px AS (SELECT block, block_rows, nt + coalesce(sum(block_rows) OVER w, 0) AS train_rows,
              st + coalesce(sum(s) OVER w, 0.0e0) AS train_sum
       FROM bl, tr WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _prefixes(spark, sf):
    """Per block: its rows, and the number and label sum of the training rows and all blocks before it."""
    prep, blocks = _test_blocks(spark, sf, 100)
    train = prep.train.agg(F.count(F.lit(1)).alias("_nt"), F.sum("label").alias("_st"))
    per = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("block_rows"), F.sum("label").alias("_s"))
    w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    return per.crossJoin(F.broadcast(train)).select(
        "block", "block_rows", (F.col("_nt") + F.coalesce(F.sum("block_rows").over(w), F.lit(0))).alias("train_rows"),
        (F.col("_st") + F.coalesce(F.sum("_s").over(w), F.lit(0.0))).alias("train_sum"))


@register("expanding_prefix", WX(_SPLIT_CTE + _PREFIX_SQL + """
SELECT block, block_rows, CAST(train_rows AS BIGINT) AS train_rows FROM px"""))
def q_expanding_prefix(spark, sf):
    """WN-14: rows available to the online model before block i (training rows + blocks < i)."""
    return _prefixes(spark, sf).select("block", "block_rows", "train_rows")


@register("expand_training", WX(_SPLIT_CTE + _PREFIX_SQL + f"""
SELECT block, CAST(train_rows AS BIGINT) AS rows, {sql_rnd('train_sum / train_rows', 4)} AS label_mean FROM px"""))
def q_expand_training(spark, sf):
    """SO-03: for every block, the training rows stacked with all the test blocks already seen."""
    return _prefixes(spark, sf).select("block", F.col("train_rows").alias("rows"),
                                       rnd(F.col("train_sum") / F.col("train_rows"), 4).alias("label_mean"))


@register("stream_score")
def q_stream_score(spark, sf):
    """ST-07: test rows arriving as files are scored by a fitted ridge; metrics per micro-batch."""
    from ..streaming import jobs as J
    prep = prepared(spark, sf)
    model = fits(spark, sf).estimator("Ridge Regression", QUERY_SIZES).fit(prep.train)
    rows = J.scratch(spark, "score-rows")
    prep.test.select("row_id", "label", "features_scaled").repartition(4, "row_id").write.parquet(rows)
    schema = spark.read.parquet(rows).schema
    return J.stream_score(spark, rows, J.scratch(spark, "score-out"), schema, model)


_FRAMEWORK_MODELS = FT.FAMILIES


@register("run_framework")
def q_run_framework(spark, sf):
    """EN-04: the whole run, one row per model.

    Feature selection on the training rows, nine families on all features,
    out-of-fold predictions of five bases (training rows only) that give both
    the CV weights of the weighted ensemble and the stacking ensemble, the
    better of the two, its improvement over every family, the gain of online
    adaptation, and the ranking."""
    f = fits(spark, sf)
    families = {n: f.full(n, QUERY_SIZES) for n in _FRAMEWORK_MODELS}
    oof, every = _bases(f)
    base_cv = f.cv([(n, STACK_SIZES) for n in _STACK_BASES]).withColumnRenamed("model", "base")
    weights = {r["base"]: (r["cv_r2"], r["weight"]) for r in MT.ensemble_weights(base_cv).collect()}  # 5 rows
    w = f.stack_weights(oof, _BASE_COLUMNS, REFERENCE_SIZES["stack_meta_alpha"])
    mixed = every.where("fold = 0").withColumn("Stacking Ensemble", _mixed(w, _BASE_COLUMNS)) \
        .withColumn("Weighted Ensemble", _mixed([weights[n][1] for n in _STACK_BASES], _BASE_COLUMNS))
    long = mixed.select("label", F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n in ("Stacking Ensemble", "Weighted Ensemble")]))
        .alias("_s")).select("label", "_s.*")
    test = f.labels().where("fold = 0").select("row_id", "label")
    for n, fit in families.items():
        long = long.unionByName(fit.scores.join(test, "row_id").select("label", F.lit(n).alias("model"), "prediction"))
    metrics = MT.regression_metrics(long, "label", "prediction", ["model"])
    facts = spark.createDataFrame(
        [(n, float(families[n].seconds) if n in families else None, *weights.get(n, (None, None)))
         for n in [*families, "Weighted Ensemble", "Stacking Ensemble"]],
        "model string, train_time double, cv_r2 double, weight double")
    rows = cut_lineage(metrics.join(facts, "model"))  # one row per model from here on
    pick = rows.where(F.col("model").isin("Weighted Ensemble", "Stacking Ensemble"))
    chosen = pick.orderBy(F.desc("r2"), F.desc("model")).limit(1)  # stacking only if strictly better
    gains = MT.improvements(rows.withColumnsRenamed({"r2": "test_r2", "rmse": "test_rmse"}),
                            chosen.withColumnsRenamed({"r2": "test_r2", "rmse": "test_rmse"}))
    adapt = _windows(spark, sf).agg(F.avg("static_r2").alias("s"), F.avg("online_r2").alias("o")) \
        .select(MT.adaptation_gain(F.col("s"), F.col("o")).alias("adaptation_gain_pct"))
    return rows.join(gains, "model", "left").crossJoin(F.broadcast(chosen.select(F.col("model").alias("_c")))) \
        .crossJoin(F.broadcast(adapt)) \
        .withColumn("chosen", F.col("model") == F.col("_c")).drop("_c") \
        .withColumn("n_features", F.lit(len(f.prep.feature_names))) \
        .withColumn("n_selected", F.lit(len(_selected(spark, sf).feature_names))) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r2"), "model")))


@register("write_results", B.with_bindings("""
SELECT model, variant, test_r2, test_rmse,
       row_number() OVER (ORDER BY test_r2 DESC, CAST(substr(variant, 3) AS BIGINT)) AS rank FROM model_runs""", "model_runs"))
def q_write_results(spark, sf):
    """SNK-05: the ranked model-results table written as CSV (header) and read back."""
    from ..sources import sinks as K
    from ..streaming import jobs as J
    from .modeling import runs
    r = runs(spark, sf).withColumn("_neg", -F.col("test_r2"))
    res = global_row_number(r, ["_neg", "row_order"], "rank").select("model", "variant", "test_r2", "test_rmse", "rank")
    path = J.scratch(spark, "results")
    K.write_results(res, path)
    return spark.read.schema(res.schema).option("header", True).csv(path)
