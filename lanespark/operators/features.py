"""Temporal and context features for the daily table, built in ONE shuffle.

All per-road windows share the same ``partitionBy(road).orderBy(date, road)``
spec, so Spark plans a single hash exchange on the road and a single sort; the
lag / rolling / trend columns are then evaluated by Window operators inside
that one stage. A daily table has at most one row per road and day, so a
road's partition is bounded by the calendar span, not by the data volume.

``leakage="parity"`` reproduces the reference exactly (rolling frames include
the current row, trend = volume - lag3, density uses volume). ``"safe"`` drops
the columns that reveal the target and ends rolling frames at the previous
row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.traffic import yes_flag
from . import calendar as C

DATE, ROAD, AREA, TARGET = "traffic_date", "road_name", "area_name", "volume"

# ---- fixed values that must equal the reference's ---------------------------
LAG_COLUMNS = ["volume", "avg_speed", "congestion"]
LAGS = [1, 3, 7]
ROLL_WINDOWS = [3, 7]
TREND_LAG = 3
# Columns never used as model features (ids, raw categories, target, and five
# extra columns of the historical table).
EXCLUDE = ["traffic_date", "area_name", "road_name", "weather", "roadwork", "volume",
           "environmental_impact", "public_transport_usage", "traffic_signal_compliance",
           "parking_usage", "pedestrian_cyclist_count"]
SHORT_TERM = ["year", "month", "day", "day_of_week", "is_weekend"]
MEDIUM_TERM = ["week_of_year", "quarter", "day_of_year", "month_sin", "month_cos", "dow_sin", "dow_cos"]
LONG_TERM = ["days_since_start", "year_progress", "quarter_sin", "quarter_cos"]
# -----------------------------------------------------------------------------


def road_window(order_tiebreak: str = ROAD) -> Window:
    return Window.partitionBy(ROAD).orderBy(DATE, order_tiebreak)


def lag_features(df: DataFrame, cols=LAG_COLUMNS, lags=LAGS) -> DataFrame:
    """WN-01: lag k *rows* per road."""
    w = road_window()
    return df.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in cols for k in lags])


def rolling_features(df: DataFrame, cols=LAG_COLUMNS, windows=ROLL_WINDOWS, leakage: str = "parity") -> DataFrame:
    """WN-02/03: trailing row-window mean (min 1 row) and sample std (NULL for 1 row)."""
    end = 0 if leakage == "parity" else -1
    out = []
    for c in cols:
        for k in windows:
            w = road_window().rowsBetween(-(k - 1) + end, end)
            out += [F.avg(c).over(w).alias(f"{c}_rollmean{k}"), F.stddev_samp(c).over(w).alias(f"{c}_rollstd{k}")]
    return df.select("*", *out)


def trend_features(df: DataFrame) -> DataFrame:
    """WN-04: value - lag3 (lag columns must exist)."""
    return df.withColumn("traffic_trend_3d", F.col(TARGET) - F.col(f"{TARGET}_lag{TREND_LAG}")) \
             .withColumn("speed_trend_3d", F.col("avg_speed") - F.col(f"avg_speed_lag{TREND_LAG}"))


def temporal_features(df: DataFrame, leakage: str = "parity") -> DataFrame:
    """FP-04: 39 temporal columns (16 calendar + 9 lag + 12 rolling + 2 trend)."""
    d = F.col(DATE)
    cal = C.days_since_start(df)
    cal = cal.select("*", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
                     C.day_of_week(d).alias("day_of_week"), C.is_weekend(d).alias("is_weekend"),
                     F.weekofyear(d).alias("week_of_year"), F.quarter(d).alias("quarter"),
                     F.dayofyear(d).alias("day_of_year"))
    ms, mc = C.cyclical(F.col("month"), 12)
    ds, dc = C.cyclical(F.col("day_of_week"), 7)
    qs, qc = C.cyclical(F.col("quarter"), 4)
    cal = cal.select("*", ms.alias("month_sin"), mc.alias("month_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"),
                     C.year_progress(d).alias("year_progress"), qs.alias("quarter_sin"), qc.alias("quarter_cos"))
    out = rolling_features(lag_features(cal), leakage=leakage)
    if leakage == "parity":
        out = trend_features(out)
    return out


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """WN-09: alphabetical code 0.. of the distinct values (NULL stays NULL)."""
    codes = df.select(col).where(F.col(col).isNotNull()).distinct() \
        .withColumn(out, F.dense_rank().over(Window.orderBy(col)) - 1)  # one row per category
    return df.join(codes, col, "left")


def first_seen_encode(df: DataFrame, col: str, order_col: str, out: str) -> DataFrame:
    """WN-10: code by first appearance in an explicit order (e.g. file position)."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_col).alias("_first"))
    codes = first.withColumn(out, F.row_number().over(Window.orderBy("_first", col)) - 1).drop("_first")
    return df.join(codes, col, "left")


def one_hot(df: DataFrame, col: str, prefix: str, categories: list[str],
            drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """FP-01: 0/1 dummies of the sorted categories, first one dropped, NULL -> all zero.

    One column per category: the caller names the categories (``label_encode``
    is the form for a column whose values are not known beforehand)."""
    cats = sorted(categories)
    keep = cats[1:] if drop_first else cats
    names = [f"{prefix}_{c.lower()}" for c in keep]
    return df.select("*", *[F.coalesce(F.col(col) == c, F.lit(False)).cast("int").alias(n)
                            for c, n in zip(keep, names)]), names


def context_enrich(df: DataFrame, categories: list[str], leakage: str = "parity") -> DataFrame:
    """FP-05: 17 context columns (needs ``is_weekend`` from the temporal stage)."""
    x = label_encode(df, AREA, "area_encoded")
    x = label_encode(x, ROAD, "road_encoded")
    x, dummies = one_hot(x, "weather", "weather", categories)
    x = x.withColumn("roadwork_flag", yes_flag("roadwork"))
    cols = [(F.col("area_encoded") * 100 + F.col("road_encoded")).alias("area_road_interaction"),
            (F.col("avg_speed") / (F.col("congestion") + F.lit(1.0))).alias("speed_congestion_ratio"),
            (F.lit(100.0) - F.col("capacity_util")).alias("capacity_utilization_gap")]
    if leakage == "parity":
        cols.append((F.col(TARGET) / (F.col("avg_speed") + F.lit(1.0))).alias("traffic_density"))
    cols += [(F.col(d) * F.col("is_weekend")).alias(f"{d}_weekend") for d in dummies]
    cols += [(F.col("incidents") * F.col("is_weekend")).alias("incident_weekend"),
             (F.col("roadwork_flag") * F.col("capacity_util")).alias("roadwork_traffic_impact")]
    return x.select("*", *cols)


def feature_table(daily: DataFrame, categories: list[str], leakage: str = "parity") -> DataFrame:
    """Stage 1 + stage 2: the full feature table."""
    return context_enrich(temporal_features(daily, leakage), categories, leakage)


def feature_columns(df: DataFrame, extra_exclude: list[str] | None = None) -> list[str]:
    """PRJ-23: every column except the exclusion list (driver-side list logic over the schema)."""
    ex = set(EXCLUDE) | set(extra_exclude or [])
    return [c for c in df.columns if c not in ex]


def classify_feature(name: str) -> str:
    """PRJ-23: category of a feature by name keyword."""
    if "_lag" in name:
        return "lag"
    if "_roll" in name:
        return "rolling"
    if "trend" in name:
        return "trend"
    if name in SHORT_TERM:
        return "short_term"
    if name in MEDIUM_TERM:
        return "medium_term"
    if name in LONG_TERM:
        return "long_term"
    return "context"


def numeric_columns(df: DataFrame) -> list[str]:
    """PRJ-27: numeric columns of a frame (schema filter)."""
    num = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in num or t.startswith("decimal")]


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ-24: drop rows with NULL (or NaN) in any feature or the target."""
    cond = None
    for c in cols:
        e = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        cond = e if cond is None else cond & e
    return df.where(cond)
