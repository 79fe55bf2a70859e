"""Regression metrics, model comparison and ensembles on result / prediction frames.

Metrics are ONE aggregation over the prediction rows (sums of errors plus a
stable population variance of the target), so they scale with the number of
predictions and can be grouped by any key (model, fold, window, split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.traffic import overfit_status

# ---- fixed values that must equal the reference's ---------------------------
EPS = 1e-10                        # denominators of improvement percentages
SKLEARN_MAPE_EPS = 2.220446049250313e-16   # float64 machine epsilon floor
UTILITY_WEIGHTS = (0.7, 0.2, 0.1)  # accuracy, speed, robustness
VARIANT_LABEL_CHARS = 15
ENSEMBLE_NAMES = ["Framework", "Stacking Ensemble", "Weighted Ensemble"]
# -----------------------------------------------------------------------------


def regression_metrics(pred: DataFrame, y: str = "actual", p: str = "predicted",
                       group: list[str] | None = None) -> DataFrame:
    """AG-36: R2 = 1 - SSE/SST, RMSE, MAE, MAPE (x100 over y > 0) and the fraction variant."""
    err = F.col(y) - F.col(p)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.sum(err * err).alias("_sse"), (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),
            F.avg(F.abs(err)).alias("mae"),
            (F.avg(F.when(F.col(y) > 0, F.abs(err / F.col(y)))) * F.lit(100.0)).alias("mape"),
            F.avg(F.abs(err) / F.greatest(F.abs(F.col(y)), F.lit(SKLEARN_MAPE_EPS))).alias("mape_fraction")]
    g = pred.groupBy(*group).agg(*aggs) if group else pred.agg(*aggs)
    return g.select(*(group or []), "n",
                    (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"),
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae", "mape", "mape_fraction")


def residual_stats(pred: DataFrame, y: str = "actual", p: str = "predicted") -> DataFrame:
    """AG-37: mean and population std of residuals."""
    r = F.col(y) - F.col(p)
    return pred.agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
                    F.min(r).alias("residual_min"), F.max(r).alias("residual_max"))


def variant_label(model: str = "model", variant: str = "variant") -> Column:
    """PRJ-25: 'Model (first 15 chars of variant)'."""
    return F.concat(F.col(model), F.lit(" ("), F.substring(variant, 1, VARIANT_LABEL_CHARS), F.lit(")"))


def with_overfit(runs: DataFrame, train: str = "train_r2", test: str = "test_r2") -> DataFrame:
    """PRJ-18 / CM-05: gap and status."""
    gap = F.col(train) - F.col(test)
    return runs.withColumn("r2_gap", gap).withColumn("overfit_status", overfit_status(gap))


def best_per_family(runs: DataFrame, score: str = "test_r2", order: str = "row_order",
                    model: str = "model", maximize: bool = True) -> DataFrame:
    """AG-39: the best row of each model (first row wins ties) — partial aggregation, no sort."""
    key = F.struct(F.col(score) if maximize else -F.col(score), -F.col(order))
    cols = [c for c in runs.columns if c != model]
    g = runs.where(F.col(model).isNotNull()).groupBy(model).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), key).alias("_b"))
    return g.select(model, "_b.*")


def variant_sensitivity(runs: DataFrame, score: str = "test_r2", model: str = "model",
                        variant: str = "variant") -> DataFrame:
    """WN-07: |score - previous variant's score| within a model, variants in string order; first = 0.

    The lag runs through ``group_lag`` (range-partitioned), so one model with a
    very large share of the runs is not sorted in a single task."""
    from .ordering import group_lag
    lagged = group_lag(runs, [model], [variant], score, "_prev_score")
    return lagged.withColumn("sensitivity", F.coalesce(F.abs(F.col(score) - F.col("_prev_score")), F.lit(0.0))) \
        .drop("_prev_score")


def utility_score(runs: DataFrame, score: str = "test_r2", time: str = "train_time",
                  sens: str = "sensitivity") -> DataFrame:
    """CM-02: 0.7 max(R2, 0) + 0.2 (1 - t / max t) + 0.1 (1 - min(sens, 1))."""
    a, b, c = UTILITY_WEIGHTS
    mt = runs.agg(F.max(time).alias("_tmax"))  # one row: broadcast scalar (JN-08)
    j = runs.crossJoin(F.broadcast(mt))
    u = (F.lit(a) * F.greatest(F.col(score), F.lit(0.0))
         + F.lit(b) * (F.lit(1.0) - F.try_divide(F.col(time), F.col("_tmax")))
         + F.lit(c) * (F.lit(1.0) - F.least(F.col(sens), F.lit(1.0))))
    return j.withColumn("utility", u).drop("_tmax")


def improvements(best: DataFrame, framework: DataFrame, r2: str = "test_r2", rmse: str = "test_rmse",
                 model: str = "model") -> DataFrame:
    """CM-01: R2 gain % and RMSE reduction % of the framework row over every baseline row."""
    f = framework.select(F.col(r2).alias("_fr2"), F.col(rmse).alias("_frmse"))  # one row
    base = best.where(~F.col(model).isin(ENSEMBLE_NAMES))
    j = base.crossJoin(F.broadcast(f))
    return j.select(model,
                    ((F.col("_fr2") - F.col(r2)) / (F.abs(F.col(r2)) + F.lit(EPS)) * F.lit(100.0)).alias("r2_improvement_pct"),
                    ((F.col(rmse) - F.col("_frmse")) / (F.col(rmse) + F.lit(EPS)) * F.lit(100.0)).alias("rmse_reduction_pct"))


def ensemble_weights(cv_scores: DataFrame, name: str = "base", score: str = "cv_r2") -> DataFrame:
    """EN-02: w = max(0, score) / sum; raises if every score is <= 0 (the reference divides by 0)."""
    pos = cv_scores.withColumn("_p", F.greatest(F.col(score), F.lit(0.0)))
    tot = pos.agg(F.sum("_p").alias("_t"))
    return pos.crossJoin(F.broadcast(tot)).select(
        name, score, F.when(F.col("_t") > 0, F.col("_p") / F.col("_t"))
        .otherwise(F.raise_error(F.lit("all ensemble weights are zero"))).alias("weight"))


def adaptation_gain(static: Column, online: Column, abs_of_sum: bool = False) -> Column:
    """ON-03: (online - static) / (|static| + 1e-10) * 100 (alternative form: |static + 1e-10|)."""
    den = F.abs(static + F.lit(EPS)) if abs_of_sum else F.abs(static) + F.lit(EPS)
    return (online - static) / den * F.lit(100.0)
