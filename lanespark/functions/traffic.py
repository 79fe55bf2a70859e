"""Scalar traffic functions as Spark column expressions (no UDFs).

Every function takes and returns ``Column`` objects so it stays inside
whole-stage codegen. ``register_sql_functions`` exposes the main ones to SQL
users as temporary SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .numeric import rnd

# ---- fixed values that must equal the reference's ---------------------------
# Weather mapping (provider category, lower-cased -> daily category).
WEATHER_RAIN = ["rain", "drizzle", "thunderstorm"]
WEATHER_FOG = ["mist", "fog", "haze", "smoke"]
WEATHER_WINDY = ["squall", "tornado"]
# 'clear', 'clouds', 'overcast' and anything else map to Clear.
WINDY_MEAN_WIND_MS = 8.0
# Congestion bands: upper bounds (exclusive) and labels, then colours.
CONGESTION_BOUNDS = [20, 40, 60, 80]
CONGESTION_LABELS = ["Free Flow", "Light", "Moderate", "Heavy", "Severe"]
CONGESTION_COLORS = ["#27ae60", "#f1c40f", "#e67e22", "#e74c3c", "#8e44ad"]
CONGESTION_UNKNOWN = "Unknown"
CONGESTION_UNKNOWN_COLOR = "#95a5a6"
# Other threshold bands (colours as the reference shows them).
SPEED_BAND_BOUNDS = [20, 30]            # x < b
SPEED_BAND_COLORS = ["#e74c3c", "#f39c12", "#27ae60"]
MAP_BAND_BOUNDS = [30, 60]              # x < b
MAP_BAND_COLORS = ["green", "orange", "red"]
SUCCESS_BAND_BOUNDS = [90, 70]          # x > b
SUCCESS_BAND_COLORS = ["#27ae60", "#f39c12", "#e74c3c"]
R2_BAND_BOUNDS = [0.9, 0.7]             # x > b
R2_BAND_COLORS = ["#d4edda", "#fff3cd", "#f8d7da"]
# Overfitting check on gap = train R2 - test R2.
OVERFIT_LABELS = ["OVERFITTING (train R² >> test R²)", "SLIGHT OVERFITTING",
                  "UNDERFITTING (test > train, unusual)", "GOOD GENERALIZATION"]
# Construction incident types and icon categories.
CONSTRUCTION_TYPES = ["CONSTRUCTION", "ROAD_WORK", "ROAD_CLOSURE"]
CONSTRUCTION_ICONS = [7, 8, 9]
# Road-dimension defaults when a road is unknown.
DEFAULT_LANES = 4
DEFAULT_CAPACITY_VPH = 4000
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x) -> Column:
    """Python truthiness of a number: not NULL and not zero."""
    x = _c(x)
    return x.isNotNull() & (x != 0)


def estimate_volume(avg_speed, free_flow, jam, capacity, hours: int = 24) -> Column:
    """Daily volume from speed ratio (piecewise flow curve) or, lacking speeds, jam factor.

    NULL when neither speeds nor a jam factor are available.
    """
    v, vf, jf, cap = _c(avg_speed), _c(free_flow), _c(jam), _c(capacity)
    u = jf / F.lit(10.0)
    jam_ratio = F.when(u <= 0.5, u * F.lit(1.8)).otherwise(F.lit(1.0) - (u - F.lit(0.5)) * F.lit(0.4))
    r = F.least(v / vf, F.lit(1.0))
    speed_ratio = (
        F.when(r > 0.9, F.lit(0.3) + F.lit(0.2) * (F.lit(1.0) - r) / F.lit(0.1))
        .when(r > 0.5, F.lit(0.5) + F.lit(0.5) * (F.lit(0.9) - r) / F.lit(0.4))
        .when(r > 0.2, F.lit(1.0) - F.lit(0.3) * (F.lit(0.5) - r) / F.lit(0.3))
        .otherwise(F.lit(0.7) * r / F.lit(0.2))
    )
    no_speed = v.isNull() | vf.isNull() | (vf == 0)
    flow = F.when(no_speed & jf.isNull(), F.lit(None).cast("double")) \
        .when(no_speed, jam_ratio).otherwise(speed_ratio)
    daily = cap * flow * F.lit(float(hours))
    # int() truncates toward zero; NULL stays NULL (greatest() would skip it)
    return F.when(daily.isNotNull(), F.greatest(F.lit(0), daily.cast("int")))


def map_weather(weather_main) -> Column:
    """Provider weather category -> daily category (never yields Overcast)."""
    w = F.lower(_c(weather_main))
    return (
        F.when(w.isin(WEATHER_RAIN), "Rain")
        .when(w.isin(WEATHER_FOG), "Fog")
        .when(w.isin(WEATHER_WINDY), "Windy")
        .otherwise("Clear")
    )


def jam_factor(speed, free_flow) -> Column:
    """(1 - min(v/vf, 1)) * 10 rounded to 2; NULL if a speed is missing or vf <= 0."""
    v, vf = _c(speed), _c(free_flow)
    ok = v.isNotNull() & vf.isNotNull() & (vf > 0)
    return F.when(ok, rnd((F.lit(1.0) - F.least(v / vf, F.lit(1.0))) * F.lit(10.0), 2))


def congestion_pct(speed, free_flow) -> Column:
    v, vf = _c(speed), _c(free_flow)
    ok = v.isNotNull() & vf.isNotNull() & (vf > 0)
    return F.when(ok, rnd((F.lit(1.0) - F.least(v / vf, F.lit(1.0))) * F.lit(100.0), 1))


def band(x, bounds, labels, null_label=None) -> Column:
    """Generic `x < b_i -> label_i` chain; the last label is the else branch."""
    x = _c(x)
    expr = F.when(x.isNull(), F.lit(null_label))
    for b, lab in zip(bounds, labels[:-1]):
        expr = expr.when(x < b, lab)
    return expr.otherwise(labels[-1])


def band_desc(x, bounds, labels) -> Column:
    """Generic `x > b_i -> label_i` chain (bounds descending); last label is the else."""
    x = _c(x)
    expr = None
    for b, lab in zip(bounds, labels[:-1]):
        expr = F.when(x > b, lab) if expr is None else expr.when(x > b, lab)
    return expr.otherwise(labels[-1])


def congestion_band(pct) -> Column:
    return band(pct, CONGESTION_BOUNDS, CONGESTION_LABELS, CONGESTION_UNKNOWN)


def congestion_color(pct) -> Column:
    return band(pct, CONGESTION_BOUNDS, CONGESTION_COLORS, CONGESTION_UNKNOWN_COLOR)


def collection_status(*ok_flags) -> Column:
    flags = [F.coalesce(_c(f), F.lit(False)) for f in ok_flags]
    all_ok = flags[0]
    any_ok = flags[0]
    for f in flags[1:]:
        all_ok = all_ok & f
        any_ok = any_ok | f
    return F.when(all_ok, "success").when(any_ok, "partial").otherwise("failed")


def traversability(road_closure) -> Column:
    return F.when(F.coalesce(_c(road_closure), F.lit(False)), "closed").otherwise("open")


def yes_flag(x) -> Column:
    """'Yes' -> 1, anything else or NULL -> 0."""
    return F.coalesce(_c(x) == "Yes", F.lit(False)).cast("int")


def overfit_status(gap) -> Column:
    g = _c(gap)
    o = OVERFIT_LABELS
    return F.when(g > 0.1, o[0]).when(g > 0.05, o[1]).when(g < -0.05, o[2]).otherwise(o[3])


def corr_strength(r) -> Column:
    a = F.abs(_c(r))
    return F.when(a > 0.7, "Strong").when(a > 0.4, "Moderate").otherwise("Weak")


def corr_direction(r) -> Column:
    return F.when(_c(r) > 0, "Positive").otherwise("Negative")


def register_sql_functions(spark: SparkSession) -> None:
    """Expose the scalar helpers to SQL users as temporary SQL functions."""
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION map_weather(w STRING) RETURNS STRING RETURN
        CASE WHEN lower(w) IN ('rain','drizzle','thunderstorm') THEN 'Rain'
             WHEN lower(w) IN ('mist','fog','haze','smoke') THEN 'Fog'
             WHEN lower(w) IN ('squall','tornado') THEN 'Windy' ELSE 'Clear' END""")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION congestion_band(p DOUBLE) RETURNS STRING RETURN
        CASE WHEN p IS NULL THEN 'Unknown' WHEN p < 20 THEN 'Free Flow' WHEN p < 40 THEN 'Light'
             WHEN p < 60 THEN 'Moderate' WHEN p < 80 THEN 'Heavy' ELSE 'Severe' END""")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION jam_factor(v DOUBLE, vf DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN v IS NULL OR vf IS NULL OR vf <= 0 THEN NULL
             ELSE round(CAST((1 - least(v / vf, 1)) * 10 AS DECIMAL(38,10)), 2) END""")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION yes_flag(x STRING) RETURNS INT RETURN
        CASE WHEN x = 'Yes' THEN 1 ELSE 0 END""")
