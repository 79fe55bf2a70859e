"""Raw readings -> one quality-checked record per (date, road).

``daily_partials`` reduces the readings to sums, counts and extremes by (date,
road) and to counts by weather and area: fixed-width buffers only, so these
are plain hash aggregates with map-side combining and a hot road stays cheap.
Partial rows merge by addition, so they also serve as the state of the
streaming job.
``merge_partials`` folds them, a few for each road and day, to the record's
statistics with the most frequent weather and the first area. The road
dimension is joined *after* that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.traffic import (DEFAULT_CAPACITY_VPH, WINDY_MEAN_WIND_MS, estimate_volume, map_weather,
                                 truthy)

DAILY_COLUMNS = [
    "traffic_date", "area_name", "road_name", "volume", "avg_speed", "tti", "congestion",
    "capacity_util", "incidents", "weather", "roadwork", "temperature", "humidity",
    "wind_speed", "rain", "visibility", "free_flow_speed", "jam_factor", "confidence",
]


def _clamp(x, lo=0.0, hi=100.0):
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


# statistic -> its columns (pooled over providers) and, for plain means, its column
POOLED = {"v": ("a_speed", "b_speed"), "ff": ("a_free_flow", "b_free_flow")}
MEANS = {"_tt": "a_travel_time", "_tff": "a_free_flow_time", "_jam": "jam_factor", "_temp": "temperature_c",
         "_hum": "humidity_pct", "_wind": "wind_speed_ms", "_rain": "rain_1h_mm", "_vis": "visibility_m",
         "_conf": "confidence"}


def daily_partials(readings: DataFrame) -> DataFrame:
    """Stage 1: mergeable rows of two kinds, each from a hash aggregate of fixed-width buffers.

    One row for each (date, road) holds sums, counts and extremes; it adds the
    readings of a road and day in one go, as rounding at the far end of a sum
    can decide a truncated volume. One row for each (date, road, weather,
    area) holds the number of readings and the first time.
    """
    known = readings.where(F.col("road_name").isNotNull() & F.col("reading_date").isNotNull()) \
        .withColumnRenamed("reading_date", "traffic_date")
    pooled = [e for k, cols in POOLED.items() for e in (
        sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in cols), F.lit(0.0)).alias(f"_s_{k}"),
        sum((F.count(c) for c in cols), F.lit(0)).cast("long").alias(f"_n_{k}"))]
    means = [e for k, c in MEANS.items() for e in (F.sum(c).alias(k + "_s"), F.count(c).alias(k + "_n"))]
    sums = known.groupBy("traffic_date", "road_name").agg(
        *pooled, *means, F.max("incident_count").alias("_inc"),
        F.max(F.coalesce("has_construction", F.lit(False))).alias("_work"))
    kinds = known.groupBy("traffic_date", "road_name", "weather_main", "area_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("reading_ts").alias("_ts"))
    return sums.unionByName(kinds, allowMissingColumns=True)


def merge_partials(parts: DataFrame) -> DataFrame:
    """Stage 2: partial rows (any number for a key) -> statistics per (date, road).

    One exchange by (date, road) serves both steps: weathers are counted
    first, then the most frequent one is taken (ties: the smallest). The area
    is that of the first reading (ties: the smallest).
    """
    key = ["traffic_date", "road_name"]
    first = F.when(F.col("_ts").isNotNull(), F.struct("_ts", F.col("area_name").isNull().alias("_no"), "area_name"))
    added = [f"_{x}_{k}" for k in POOLED for x in "sn"] + [k + x for k in MEANS for x in ("_s", "_n")]
    rest = [F.max("_inc").alias("_inc"), F.max("_work").alias("_work"), *[F.sum(c).alias(c) for c in added]]
    by_weather = parts.repartition(*key).groupBy(*key, "weather_main").agg(
        F.sum("_n").alias("_n"), F.min(first).alias("_first"), *rest)
    seen = F.when(F.col("weather_main").isNotNull(), F.struct((-F.col("_n")).alias("_rank"), "weather_main"))
    one = by_weather.groupBy(*key).agg(F.min("_first").alias("_first"), F.min(seen).alias("_seen"), *rest)
    means = [F.when(F.col(k + "_n") > 0, F.col(k + "_s") / F.col(k + "_n")).alias(k) for k in MEANS]
    return one.select(*key, F.col("_first.area_name").alias("area_name"), "_s_v", "_n_v", "_s_ff", "_n_ff", *means,
                      "_inc", F.col("_seen.weather_main").alias("_wmode"), "_work")


def daily_aggregates(readings: DataFrame) -> DataFrame:
    """Sufficient statistics per (date, road)."""
    return merge_partials(daily_partials(readings))


def daily_finalize(agg: DataFrame, road_dim: DataFrame | None) -> DataFrame:
    """Stage 3: per-row projections of the aggregates (no shuffle besides the dim lookup)."""
    if road_dim is not None:
        dim = road_dim.select("road_name", "lanes", "max_capacity_vph")
        agg = agg.join(dim, "road_name", "left")
    else:
        agg = agg.withColumn("lanes", F.lit(None).cast("int")) \
                 .withColumn("max_capacity_vph", F.lit(None).cast("int"))
    cap = F.coalesce(F.col("max_capacity_vph"), F.lit(DEFAULT_CAPACITY_VPH))
    v = F.when(F.col("_n_v") > 0, F.col("_s_v") / F.col("_n_v"))
    vf = F.when(F.col("_n_ff") > 0, F.col("_s_ff") / F.col("_n_ff"))
    df = agg.withColumn("_v", v).withColumn("_vf", vf)
    v, vf, jam = F.col("_v"), F.col("_vf"), F.col("_jam")
    speeds_ok = truthy(v) & truthy(vf) & (vf > 0)
    tti = (F.when(F.col("_tt").isNotNull() & F.col("_tff").isNotNull(),
                  F.least(F.col("_tt") / F.greatest(F.col("_tff"), F.lit(1.0)), F.lit(3.0)))
           .when(truthy(v) & truthy(vf) & (v > 0), F.least(vf / v, F.lit(3.0)))
           .otherwise(F.lit(1.0)))
    congestion = _clamp(
        F.when(jam.isNotNull(), (jam / F.lit(10.0)) * F.lit(100.0))
        .when(speeds_ok, (F.lit(1.0) - v / vf) * F.lit(100.0))
        .otherwise(F.lit(50.0)))
    df = df.withColumn("_cong", congestion)
    capacity = F.when(speeds_ok, _clamp((F.lit(1.0) - v / vf) * F.lit(100.0))).otherwise(F.col("_cong"))
    volume = F.coalesce(estimate_volume(v, vf, jam, cap), (cap * F.lit(12)).cast("int"))
    weather = F.when(F.col("_wind") > WINDY_MEAN_WIND_MS, F.lit("Windy")) \
        .when(F.col("_wmode").isNull(), F.lit("Clear")) \
        .otherwise(map_weather("_wmode"))
    return df.select(
        "traffic_date", "area_name", "road_name",
        volume.cast("int").alias("volume"),
        F.when(truthy(v), rnd(v, 2)).otherwise(F.lit(30.0)).alias("avg_speed"),
        rnd(tti, 4).alias("tti"),
        rnd(F.col("_cong"), 2).alias("congestion"),
        rnd(capacity, 2).alias("capacity_util"),
        F.coalesce(F.col("_inc"), F.lit(0)).cast("int").alias("incidents"),
        weather.alias("weather"),
        F.when(F.col("_work"), "Yes").otherwise("No").alias("roadwork"),
        rnd("_temp", 2).alias("temperature"),
        rnd("_hum", 2).alias("humidity"),
        rnd("_wind", 2).alias("wind_speed"),
        F.coalesce(rnd("_rain", 2), F.lit(0.0)).alias("rain"),
        rnd("_vis", 2).alias("visibility"),
        F.when(truthy(vf), rnd(vf, 2)).alias("free_flow_speed"),
        rnd(jam, 4).alias("jam_factor"),
        rnd("_conf", 4).alias("confidence"),
    )


def daily_rollup(readings: DataFrame, road_dim: DataFrame | None = None) -> DataFrame:
    """AG-01: the full 19-column daily record per (date, road)."""
    return daily_finalize(daily_aggregates(readings), road_dim)


def replace_dates(existing: DataFrame, batch: DataFrame, date_col: str = "traffic_date") -> DataFrame:
    """SNK-02 query form: drop existing rows whose date is in the batch, then union.

    Applying the same batch twice gives the same table (idempotent).
    """
    dates = batch.select(date_col).distinct()
    kept = existing.join(dates, date_col, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)
