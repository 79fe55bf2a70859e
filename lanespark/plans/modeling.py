"""Model-result analytics: metrics, comparison, ranking, ensembles (model_runs / predictions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traffic as T
from ..functions.numeric import rnd, sql_rnd as R
from ..operators import metrics as MT
from ..operators.profile import histogram
from ..sources import bindings as B
from .registry import register


def runs(spark, sf):
    r = B.model_runs(spark, sf)
    return r.withColumn("row_order", F.substring("variant", 3, 100).cast("long"))


def preds(spark, sf):
    return B.predictions(spark, sf)


def MX(text: str, *names: str) -> str:
    ctes = [B.ORACLE_CTE[n].strip() for n in (names or ("model_runs",))]
    return "WITH " + ",\n".join(ctes) + ",\n" + text.strip()


def MW(sql: str) -> str:
    return B.with_bindings(sql, "model_runs")


def PW(sql: str) -> str:
    return B.with_bindings(sql, "predictions")


RUNS_O = "runs AS (SELECT *, CAST(substr(variant, 3) AS BIGINT) AS row_order FROM model_runs)"
OVERFIT_SQL = ("CASE WHEN train_r2 - test_r2 > 0.1 THEN 'OVERFITTING (train R² >> test R²)' "
               "WHEN train_r2 - test_r2 > 0.05 THEN 'SLIGHT OVERFITTING' "
               "WHEN train_r2 - test_r2 < -0.05 THEN 'UNDERFITTING (test > train, unusual)' "
               "ELSE 'GOOD GENERALIZATION' END")


def _metric_cols(digits=6):
    return ["n", *[f"{c}" for c in ("r2", "rmse", "mae", "mape", "mape_fraction")]]


def _round_metrics(df, keys=()):
    return df.select(*keys, "n", *[rnd(c, 6).alias(c) for c in ("r2", "rmse", "mae", "mape", "mape_fraction")])


_METRICS_SQL = f"""
SELECT count(*) AS n, {R('1.0e0 - sum((actual - predicted) * (actual - predicted)) / nullif(var_pop(actual) * count(*), 0)', 6)} AS r2,
       {R('sqrt(sum((actual - predicted) * (actual - predicted)) / count(*))', 6)} AS rmse,
       {R('avg(abs(actual - predicted))', 6)} AS mae,
       {R('avg(abs((actual - predicted) / actual)) FILTER (WHERE actual > 0) * 100.0e0', 6)} AS mape,
       {R('avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16))', 6)} AS mape_fraction"""


@register("regression_metrics", PW(_METRICS_SQL + " FROM predictions"), headline=True)
def q_regression_metrics(spark, sf):
    """AG-36 over every prediction row."""
    return _round_metrics(MT.regression_metrics(preds(spark, sf)))


@register("regression_metrics_by_line", PW(_METRICS_SQL.replace("SELECT count(*)", "SELECT l_linenumber, count(*)")
                                           + " FROM predictions GROUP BY 1"))
def q_regression_metrics_by_line(spark, sf):
    """AG-36 grouped (one row per segment), same single aggregation."""
    return _round_metrics(MT.regression_metrics(preds(spark, sf), group=["l_linenumber"]), ["l_linenumber"])


@register("positive_target", PW(f"""
SELECT count(*) FILTER (WHERE actual > 0) AS n_positive,
       {R('avg(abs((actual - predicted) / actual)) FILTER (WHERE actual > 0) * 100.0e0', 6)} AS mape FROM predictions"""))
def q_positive_target(spark, sf):
    """FLT-07: MAPE only over y > 0."""
    p = preds(spark, sf)
    pos = F.col("actual") > 0
    return p.agg(F.count_if(pos).alias("n_positive"),
                 rnd(F.avg(F.when(pos, F.abs((F.col("actual") - F.col("predicted")) / F.col("actual"))))
                     * F.lit(100.0), 6).alias("mape"))


@register("residual_stats", PW(f"""
SELECT {R('avg(actual - predicted)', 4)} AS residual_mean, {R('stddev_pop(actual - predicted)', 4)} AS residual_std,
       {R('min(actual - predicted)', 4)} AS residual_min, {R('max(actual - predicted)', 4)} AS residual_max
FROM predictions"""))
def q_residual_stats(spark, sf):
    """AG-37."""
    s = MT.residual_stats(preds(spark, sf))
    return s.select(*[rnd(c, 4).alias(c) for c in s.columns])


@register("residual_histogram", B.with_bindings(f"""
SELECT bin, {R('lo + bin * ((hi - lo) / 50.0e0)', 4)} AS bin_low, {R('lo + (bin + 1) * ((hi - lo) / 50.0e0)', 4)} AS bin_high,
       count(*) AS count
FROM (SELECT CAST(CASE WHEN (hi - lo) / 50.0e0 = 0 THEN 0
                  ELSE least(floor((res - lo) / ((hi - lo) / 50.0e0)), 49) END AS INT) AS bin, lo, hi
      FROM (SELECT actual - predicted AS res FROM predictions) p,
           (SELECT min(actual - predicted) AS lo, max(actual - predicted) AS hi FROM predictions) r)
GROUP BY bin, lo, hi""", "predictions"))
def q_residual_histogram(spark, sf):
    """AG-37 residual histogram (AG-20 on residuals)."""
    r = preds(spark, sf).select((F.col("actual") - F.col("predicted")).alias("res"))
    return histogram(r, "res", 50)


@register("variant_labels", MW("""
SELECT model, variant, model || ' (' || substr(variant, 1, 15) || ')' AS label FROM model_runs"""))
def q_variant_labels(spark, sf):
    """PRJ-25."""
    return runs(spark, sf).select("model", "variant", MT.variant_label().alias("label"))


@register("overfit_status", MW(f"""
SELECT model, variant, {R('train_r2 - test_r2', 6)} AS r2_gap, {OVERFIT_SQL} AS overfit_status FROM model_runs"""))
def q_overfit_status(spark, sf):
    """PRJ-18."""
    r = MT.with_overfit(runs(spark, sf))
    return r.select("model", "variant", rnd("r2_gap", 6).alias("r2_gap"), "overfit_status")


@register("r2_band", MW("""
SELECT model, variant, CASE WHEN test_r2 > 0.9 THEN '#d4edda' WHEN test_r2 > 0.7 THEN '#fff3cd' ELSE '#f8d7da' END AS r2_color
FROM model_runs"""))
def q_r2_band(spark, sf):
    """PRJ-17 (R2 band of the comparison table)."""
    return runs(spark, sf).select("model", "variant",
                                  T.band_desc("test_r2", T.R2_BAND_BOUNDS, T.R2_BAND_COLORS).alias("r2_color"))


@register("best_per_family", MX(RUNS_O + f"""
SELECT model, variant, {R('test_r2', 6)} AS test_r2, test_rmse, train_time FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_r2 DESC, row_order) AS rn FROM runs
  WHERE model IS NOT NULL) WHERE rn = 1"""))
def q_best_per_family(spark, sf):
    """AG-39: best test R2 per model, first row on ties (max_by, partial aggregation)."""
    b = MT.best_per_family(runs(spark, sf))
    return b.select("model", "variant", rnd("test_r2", 6).alias("test_r2"), "test_rmse", "train_time")


@register("global_best", MX(RUNS_O + f"""
SELECT arg_max(model, (test_r2, -row_order)) AS best_r2_model, arg_max(variant, (test_r2, -row_order)) AS best_r2_variant,
       arg_min(model, (test_rmse, row_order)) AS best_rmse_model, arg_min(variant, (test_rmse, row_order)) AS best_rmse_variant
FROM runs"""))
def q_global_best(spark, sf):
    """AG-40."""
    r = runs(spark, sf)
    kmax = F.struct("test_r2", (-F.col("row_order")).alias("o"))
    kmin = F.struct("test_rmse", "row_order")
    return r.agg(F.max_by("model", kmax).alias("best_r2_model"), F.max_by("variant", kmax).alias("best_r2_variant"),
                 F.min_by("model", kmin).alias("best_rmse_model"), F.min_by("variant", kmin).alias("best_rmse_variant"))


@register("multi_row_groups", MW("""
SELECT model, variant FROM model_runs WHERE model IN (SELECT model FROM model_runs GROUP BY model HAVING count(*) > 1)"""))
def q_multi_row_groups(spark, sf):
    """FLT-06: rows of models that have more than one variant (HAVING + semi join)."""
    r = runs(spark, sf)
    multi = r.groupBy("model").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("model")
    return r.join(multi, "model", "left_semi").select("model", "variant")


_SENS_SQL = "coalesce(abs(test_r2 - lag(test_r2) OVER (PARTITION BY model ORDER BY variant)), 0.0e0)"


@register("variant_sensitivity", MW(f"SELECT model, variant, {R(_SENS_SQL, 6)} AS sensitivity FROM model_runs"))
def q_variant_sensitivity(spark, sf):
    """WN-07: variants compared in string order within each model."""
    s = MT.variant_sensitivity(runs(spark, sf))
    return s.select("model", "variant", rnd("sensitivity", 6).alias("sensitivity"))


@register("utility_score", MW(f"""
SELECT model, variant, {R('0.7e0 * greatest(test_r2, 0.0e0) + 0.2e0 * (1.0e0 - train_time / max(train_time) OVER ()) + 0.1e0 * (1.0e0 - least(sens, 1.0e0))', 6)} AS utility
FROM (SELECT *, {_SENS_SQL} AS sens FROM model_runs)"""))
def q_utility_score(spark, sf):
    """CM-02."""
    u = MT.utility_score(MT.variant_sensitivity(runs(spark, sf)))
    return u.select("model", "variant", rnd("utility", 6).alias("utility"))


@register("model_ranking", MX(RUNS_O + """
SELECT model, variant, CAST(row_number() OVER (ORDER BY test_r2 DESC, row_order) AS INT) AS rank FROM runs"""))
def q_model_ranking(spark, sf):
    """CM-03: rank all runs by test R2 (distributed numbering: the runs table grows with the data)."""
    from ..operators.ordering import global_row_number
    r = runs(spark, sf).withColumn("_neg", -F.col("test_r2"))
    ranked = global_row_number(r, ["_neg", "row_order"], "rank")
    return ranked.select("model", "variant", F.col("rank").cast("int").alias("rank"))


@register("topk_models", MX(RUNS_O + f"""
SELECT model, variant, {R('test_r2', 6)} AS test_r2 FROM runs ORDER BY test_r2 DESC, row_order LIMIT 10"""))
def q_topk_models(spark, sf):
    """SL-03: top 10 by test R2 (TakeOrderedAndProject: no full sort)."""
    r = runs(spark, sf).orderBy(F.desc("test_r2"), "row_order").limit(10)
    return r.select("model", "variant", rnd("test_r2", 6).alias("test_r2"))


@register("before_after", MX(RUNS_O + f""",
orig AS (SELECT model, arg_min(variant, row_order) AS original_variant, arg_min(test_r2, row_order) AS r2_before,
                arg_min(test_rmse, row_order) AS rmse_before FROM runs GROUP BY 1),
imp AS (SELECT r.model, arg_max(r.variant, (r.test_r2, -r.row_order)) AS improved_variant,
               arg_max(r.test_r2, (r.test_r2, -r.row_order)) AS r2_after,
               arg_max(r.test_rmse, (r.test_r2, -r.row_order)) AS rmse_after
        FROM runs r JOIN orig o ON o.model = r.model WHERE r.variant <> o.original_variant GROUP BY 1)
SELECT o.model, original_variant, improved_variant, {R('r2_after - r2_before', 6)} AS r2_gain,
       {R('(rmse_before - rmse_after) / (rmse_before + 1e-10) * 100.0e0', 4)} AS rmse_reduction_pct
FROM orig o JOIN imp i ON i.model = o.model"""))
def q_before_after(spark, sf):
    """CM-04: original (first) variant vs the best other variant of each model."""
    r = runs(spark, sf)
    first = F.struct("row_order")
    orig = r.groupBy("model").agg(F.min_by("variant", first).alias("original_variant"),
                                  F.min_by("test_r2", first).alias("r2_before"),
                                  F.min_by("test_rmse", first).alias("rmse_before"))
    key = F.struct("test_r2", (-F.col("row_order")).alias("o"))
    others = r.join(orig.select("model", "original_variant"), "model").where(F.col("variant") != F.col("original_variant"))
    imp = others.groupBy("model").agg(F.max_by("variant", key).alias("improved_variant"),
                                      F.max_by("test_r2", key).alias("r2_after"),
                                      F.max_by("test_rmse", key).alias("rmse_after"))
    j = orig.join(imp, "model")
    return j.select("model", "original_variant", "improved_variant",
                    rnd(F.col("r2_after") - F.col("r2_before"), 6).alias("r2_gain"),
                    rnd((F.col("rmse_before") - F.col("rmse_after")) / (F.col("rmse_before") + F.lit(1e-10))
                        * F.lit(100.0), 4).alias("rmse_reduction_pct"))


@register("overfit_report", MW(f"""
SELECT model, {R('avg(train_r2)', 6)} AS train_r2, {R('avg(test_r2)', 6)} AS test_r2,
       {R('avg(train_r2) - avg(test_r2)', 6)} AS r2_difference,
       CASE WHEN avg(train_r2) - avg(test_r2) > 0.1 THEN 'OVERFITTING (train R² >> test R²)'
            WHEN avg(train_r2) - avg(test_r2) > 0.05 THEN 'SLIGHT OVERFITTING'
            WHEN avg(train_r2) - avg(test_r2) < -0.05 THEN 'UNDERFITTING (test > train, unusual)'
            ELSE 'GOOD GENERALIZATION' END AS overfit_status
FROM model_runs GROUP BY 1"""))
def q_overfit_report(spark, sf):
    """CM-05: train vs test per model family."""
    g = runs(spark, sf).groupBy("model").agg(F.avg("train_r2").alias("_tr"), F.avg("test_r2").alias("_te"))
    return g.select("model", rnd("_tr", 6).alias("train_r2"), rnd("_te", 6).alias("test_r2"),
                    rnd(F.col("_tr") - F.col("_te"), 6).alias("r2_difference"),
                    T.overfit_status(F.col("_tr") - F.col("_te")).alias("overfit_status"))


@register("improvements", MX(RUNS_O + f""",
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_r2 DESC, row_order) AS rn
                        FROM runs) WHERE rn = 1),
fw AS (SELECT test_r2 AS fr2, test_rmse AS frmse FROM runs ORDER BY test_r2 DESC, row_order LIMIT 1)
SELECT model, {R('(fr2 - test_r2) / (abs(test_r2) + 1e-10) * 100.0e0', 4)} AS r2_improvement_pct,
       {R('(test_rmse - frmse) / (test_rmse + 1e-10) * 100.0e0', 4)} AS rmse_reduction_pct
FROM best, fw"""))
def q_improvements(spark, sf):
    """CM-01: the overall best run (as the framework row) against every family's best run."""
    r = runs(spark, sf)
    best = MT.best_per_family(r)
    fw = r.orderBy(F.desc("test_r2"), "row_order").limit(1)
    imp = MT.improvements(best, fw)
    return imp.select("model", rnd("r2_improvement_pct", 4).alias("r2_improvement_pct"),
                      rnd("rmse_reduction_pct", 4).alias("rmse_reduction_pct"))


@register("broadcast_scalar", MW(f"""
SELECT model, variant, {R('test_r2 - avg(test_r2) OVER ()', 6)} AS r2_vs_mean,
       {R('min(test_r2) OVER ()', 6)} AS r2_min, {R('max(test_r2) OVER ()', 6)} AS r2_max FROM model_runs"""))
def q_broadcast_scalar(spark, sf):
    """JN-08: global min/mean/max attached to every row through a 1-row broadcast."""
    r = runs(spark, sf)
    s = r.agg(F.avg("test_r2").alias("_m"), F.min("test_r2").alias("_lo"), F.max("test_r2").alias("_hi"))
    j = r.crossJoin(F.broadcast(s))
    return j.select("model", "variant", rnd(F.col("test_r2") - F.col("_m"), 6).alias("r2_vs_mean"),
                    rnd("_lo", 6).alias("r2_min"), rnd("_hi", 6).alias("r2_max"))


# ---- ensembles on given predictions -------------------------------------------------
# The given predictions carry no signal of the actual values, so the base predictors are simulated readings of it
# with errors from the given prediction. They cover all prediction rows; five folds by order key. A base's CV score is the mean of its
# folds' R2; the stacked prediction of a fold is a least-squares fit of the actual on p_price in the other folds.

_BASES_SQL = """
bases AS (SELECT l_orderkey, l_linenumber, l_orderkey % 5 AS fold, actual,
                 0.6e0 * actual + 0.4e0 * predicted AS p_price, 0.5e0 * actual + 0.4e0 * predicted AS p_discounted,
                 0.8e0 * actual + 0.1e0 * predicted AS p_shrunk FROM predictions),
long AS (SELECT fold, actual, 'p_price' AS base, p_price AS pred FROM bases
         UNION ALL SELECT fold, actual, 'p_discounted', p_discounted FROM bases
         UNION ALL SELECT fold, actual, 'p_shrunk', p_shrunk FROM bases),
per AS (SELECT base, fold, 1.0e0 - sum((actual - pred) * (actual - pred)) / nullif(var_pop(actual) * count(*), 0) AS r2
        FROM long GROUP BY 1, 2),
cv AS (SELECT base, avg(r2) AS cv_r2 FROM per GROUP BY 1),
wt AS (SELECT base, cv_r2, greatest(cv_r2, 0.0e0) / sum(greatest(cv_r2, 0.0e0)) OVER () AS weight FROM cv),
w1 AS (SELECT max(weight) FILTER (WHERE base = 'p_price') AS w_price,
              max(weight) FILTER (WHERE base = 'p_discounted') AS w_discounted,
              max(weight) FILTER (WHERE base = 'p_shrunk') AS w_shrunk FROM wt),
ens AS (SELECT actual, w_price * p_price + w_discounted * p_discounted + w_shrunk * p_shrunk AS weighted
        FROM bases, w1),
sums AS (SELECT fold, count(*) AS n, avg(p_price) AS mx, avg(actual) AS my, var_pop(p_price) AS vx,
                covar_pop(p_price, actual) AS cxy FROM bases GROUP BY 1),
meta AS (SELECT a.fold, sum(b.n * b.mx) / sum(b.n) AS mx, sum(b.n * b.my) / sum(b.n) AS my,
                sum(b.n * (b.cxy + b.mx * b.my)) / sum(b.n) AS exy, sum(b.n * (b.vx + b.mx * b.mx)) / sum(b.n) AS exx
         FROM sums a JOIN sums b ON a.fold <> b.fold GROUP BY 1),
stk AS (SELECT actual, my + (exy - mx * my) / (exx - mx * mx) * (p_price - mx) AS stacked FROM bases JOIN meta USING (fold))"""


def _bases(spark, sf):
    p = preds(spark, sf)
    mix = lambda a, b: F.lit(a) * F.col("actual") + F.lit(b) * F.col("predicted")
    return p.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 5).alias("fold"), "actual",
                    mix(0.6, 0.4).alias("p_price"), mix(0.5, 0.4).alias("p_discounted"), mix(0.8, 0.1).alias("p_shrunk"))


_BASE_NAMES = ["p_price", "p_discounted", "p_shrunk"]


def _weighted(spark, sf):
    b = _bases(spark, sf)
    # one pass over the rows gives every base's R2 in every fold (15 numbers)
    err = [F.sum((F.col("actual") - F.col(n)) * (F.col("actual") - F.col(n))).alias(n) for n in _BASE_NAMES]
    per = b.groupBy("fold").agg((F.var_pop("actual") * F.count(F.lit(1))).alias("_sst"), *err)
    cv = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("base"), (F.lit(1.0) - F.try_divide(
        F.col(n), F.col("_sst"))).alias("r2")) for n in _BASE_NAMES])).alias("_s")).select("_s.*") \
        .groupBy("base").agg(F.avg("r2").alias("cv_r2"))
    w = MT.ensemble_weights(cv)  # one row per base model
    # pivot the weights to ONE row and broadcast it: the weighted sum is then a
    # per-row projection of the base predictions (no shuffle of prediction rows)
    w1 = w.agg(*[F.max(F.when(F.col("base") == n, F.col("weight"))).alias(f"w_{n}") for n in _BASE_NAMES])
    weighted = None
    for n in _BASE_NAMES:
        term = F.col(f"w_{n}") * F.col(n)
        weighted = term if weighted is None else weighted + term
    ens = b.crossJoin(F.broadcast(w1)).select("actual", weighted.alias("weighted"))
    return w, ens


def _stacked(spark, sf):
    """Out-of-fold least squares of the actual on p_price: the moments of the other four folds (5 rows)."""
    b = _bases(spark, sf)
    m = b.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("p_price").alias("mx"), F.avg("actual").alias("my"),
                              F.var_pop("p_price").alias("vx"), F.covar_pop("p_price", "actual").alias("cxy"))
    o = m.select(F.col("fold").alias("other"), "n", "mx", "my", "vx", "cxy")
    mean = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    x, y = F.col("mx"), F.col("my")
    meta = m.select("fold").join(F.broadcast(o), F.col("fold") != F.col("other")).groupBy("fold").agg(
        mean(x).alias("ex"), mean(y).alias("ey"), mean(F.col("cxy") + x * y).alias("exy"),
        mean(F.col("vx") + x * x).alias("exx"))
    slope = (F.col("exy") - F.col("ex") * F.col("ey")) / (F.col("exx") - F.col("ex") * F.col("ex"))
    return b.join(F.broadcast(meta), "fold").select(
        "actual", (F.col("ey") + slope * (F.col("p_price") - F.col("ex"))).alias("stacked"))


def EX(sql: str) -> str:
    """Oracle over the prediction binding plus the base-model / weight CTEs."""
    return MX(_BASES_SQL.strip() + "\n" + sql.strip(), "predictions")


@register("ensemble_weights", EX(f"SELECT base, {R('cv_r2', 6)} AS cv_r2, {R('weight', 6)} AS weight FROM wt"))
def q_ensemble_weights(spark, sf):
    """EN-02 weights: max(0, CV R2) / sum."""
    w, _ = _weighted(spark, sf)
    return w.select("base", rnd("cv_r2", 6).alias("cv_r2"), rnd("weight", 6).alias("weight"))


@register("weighted_ensemble", EX(_METRICS_SQL.replace("predicted", "weighted") + " FROM ens"))
def q_weighted_ensemble(spark, sf):
    """EN-02: weighted sum of base predictions, evaluated with AG-36."""
    _, ens = _weighted(spark, sf)
    return _round_metrics(MT.regression_metrics(ens, "actual", "weighted"))


@register("pick_best", EX("""
SELECT CASE WHEN """ + R("s.r2", 10) + " > " + R("w.r2", 10) + """ THEN 'Stacking Ensemble' ELSE 'Weighted Ensemble' END AS chosen,
       """ + R("s.r2", 6) + " AS stacking_r2, " + R("w.r2", 6) + """ AS weighted_r2 FROM
  (SELECT 1.0e0 - sum((actual - stacked) * (actual - stacked)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM stk) s,
  (SELECT 1.0e0 - sum((actual - weighted) * (actual - weighted)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM ens) w"""))
def q_pick_best(spark, sf):
    """EN-03: stacking only if its R2 is strictly greater than the weighted ensemble's."""
    _, ens = _weighted(spark, sf)
    s = MT.regression_metrics(_stacked(spark, sf), "actual", "stacked").select(F.col("r2").alias("_s"))
    w = MT.regression_metrics(ens, "actual", "weighted").select(F.col("r2").alias("_w"))
    # "strictly greater" at 1e-10: two R2 values of identical predictions must not be
    # separated by the summation order of their aggregations
    return s.crossJoin(w).select(F.when(rnd("_s", 10) > rnd("_w", 10), "Stacking Ensemble")
                                 .otherwise("Weighted Ensemble").alias("chosen"),
                                 rnd("_s", 6).alias("stacking_r2"), rnd("_w", 6).alias("weighted_r2"))
