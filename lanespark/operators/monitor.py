"""Collection monitoring over raw readings (cycle history, KPIs, live snapshot).

A *cycle* is one 15-minute collection round. Everything here is a grouped
aggregation with map-side combining; "latest per road" and "first per cycle"
find the time by a hash aggregate, so a road with very many readings is
reduced on every map task, and only the readings of that time are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as T
from ..functions.numeric import rnd

# ---- fixed values that must equal the reference's ---------------------------
ROADS_PER_CYCLE = 16
CYCLES_PER_DAY = 96            # one cycle every 15 minutes
MIN_WEATHER_GROUP = 5          # weather groups need at least 5 readings
DISPLAY_NAMES = {              # raw column -> display name
    "reading_ts": "Timestamp", "reading_date": "Date", "reading_hour": "Hour",
    "road_name": "Road Name", "area_name": "Area Name",
    "a_speed": "Current Speed (km/h)", "a_free_flow": "Free Flow Speed (km/h)",
    "a_travel_time": "Travel Time (s)", "a_free_flow_time": "Free Flow Travel Time (s)",
    "confidence": "Confidence", "road_closure": "Road Closure",
    "b_speed": "Speed - HERE (km/h)", "b_free_flow": "Free Flow - HERE (km/h)",
    "jam_factor": "Jam Factor (0-10)", "weather_main": "Weather",
    "temperature_c": "Temperature (C)", "humidity_pct": "Humidity (%)",
    "wind_speed_ms": "Wind Speed (m/s)", "visibility_m": "Visibility (m)", "rain_1h_mm": "Rain (mm/h)",
    "lanes": "Lanes", "max_capacity_vph": "Max Capacity (vph)",
    "incident_count": "Incidents", "has_construction": "Construction", "collection_status": "Status",
}
# -----------------------------------------------------------------------------


def cycle_key(ts="reading_ts") -> Column:
    """15-minute cycle label 'yyyy-MM-dd HH:mm' (minute floored to 0/15/30/45)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.date_format(t, "yyyy-MM-dd HH:"),
                    F.lpad((F.floor(F.minute(t) / 15) * 15).cast("int").cast("string"), 2, "0"))


def with_cycle(r: DataFrame) -> DataFrame:
    return r.withColumn("cycle", cycle_key())


def first_per_cycle(r: DataFrame, cols: list[str]) -> DataFrame:
    """Each cycle's first reading (ties: smallest event id): ``cycle`` and ``cols``.

    The first time comes from a hash aggregate; only the readings of that time
    reach the tie break."""
    c = with_cycle(r)
    times = c.groupBy(F.col("cycle").alias("_cycle")).agg(F.min("reading_ts").alias("_ts"))
    at_first = c.join(times, (F.col("cycle") == F.col("_cycle")) & (F.col("reading_ts") == F.col("_ts")))
    return at_first.groupBy("cycle").agg(F.min_by(F.struct(*cols), F.struct("event_id")).alias("_row")) \
        .select("cycle", *[F.col("_row")[x].alias(x) for x in cols])


def collection_history(r: DataFrame) -> DataFrame:
    """AG-23: per cycle: roads reported, mean speed (1 dp), successes."""
    return with_cycle(r).groupBy("cycle").agg(
        F.count("road_name").alias("roads"), rnd(F.avg("a_speed"), 1).alias("avg_speed"),
        F.count_if(F.col("collection_status") == "success").alias("successes"))


def running_success(r: DataFrame) -> DataFrame:
    """WN-12: cumulative success rate over cycles (window over the per-cycle frame)."""
    h = collection_history(r)
    w = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    return h.select("cycle", "successes",
                    F.sum("successes").over(w).alias("total_success"),
                    F.count(F.lit(1)).over(w).alias("collections"),
                    rnd(F.sum("successes").over(w) * F.lit(100.0)
                        / (F.count(F.lit(1)).over(w) * F.lit(ROADS_PER_CYCLE)), 4).alias("success_rate"))


def latest_per_road(r: DataFrame, cols: list[str]) -> DataFrame:
    """WN-11 (per road): the newest reading of each road, ties broken by event id.

    The newest time per road comes from a hash aggregate over two columns; only
    the readings of that time (a few per road) reach the tie break."""
    known = r.where(F.col("road_name").isNotNull())
    newest = known.groupBy(F.col("road_name").alias("_road")).agg(F.max("reading_ts").alias("_ts"))
    at_newest = known.join(newest, (F.col("road_name") == F.col("_road"))
                           & F.col("reading_ts").eqNullSafe(F.col("_ts")))
    g = at_newest.groupBy("road_name").agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct("reading_ts", "event_id")).alias("_last"))
    return g.select("road_name", "_last.*")


def newest_snapshot(r: DataFrame) -> DataFrame:
    """WN-11 (whole table): all readings of the newest time."""
    newest = r.agg(F.max("reading_ts").alias("_ts"))  # one row
    return r.join(F.broadcast(newest), F.col("reading_ts") == F.col("_ts"), "left_semi")


def incident_sampling(r: DataFrame, minute_limit: int = 15) -> DataFrame:
    """PRJ-30: incidents only fetched in the first cycle of the hour; other rows -> 0/false, 'skipped'."""
    keep = F.minute("reading_ts") < minute_limit
    return r.select(
        "event_id",
        F.when(keep, F.col("incident_count")).otherwise(F.lit(0)).alias("incident_count"),
        F.when(keep, F.col("has_construction")).otherwise(F.lit(False)).alias("has_construction"),
        F.when(keep, F.lit("fetched")).otherwise(F.lit("skipped")).alias("incident_status"))


def rename_display(df: DataFrame) -> DataFrame:
    """PRJ-22."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


def facet_filter(df: DataFrame, date=None, area="All", road="All") -> DataFrame:
    """FLT-02: optional equality filters, 'All' (or None) means no filter."""
    if date not in (None, "All"):
        df = df.where(F.col("reading_date") == F.lit(date).cast("date"))
    if area not in (None, "All"):
        df = df.where(F.col("area_name") == area)
    if road not in (None, "All"):
        df = df.where(F.col("road_name") == road)
    return df


def join_road_dim(r: DataFrame, dim: DataFrame) -> DataFrame:
    """JN-01: left lookup with defaults for unknown roads.

    No hint: the dimension's size is data-driven here, so AQE decides at run
    time (broadcast below ``autoBroadcastJoinThreshold``, sort-merge above).
    """
    d = dim.select("road_name", "lanes", "max_capacity_vph")
    return r.join(d, "road_name", "left").select(
        *[c for c in r.columns],
        F.coalesce("lanes", F.lit(T.DEFAULT_LANES)).alias("lanes"),
        F.coalesce("max_capacity_vph", F.lit(T.DEFAULT_CAPACITY_VPH)).alias("max_capacity_vph"))


def pool_providers(r: DataFrame) -> DataFrame:
    """SO-02: both providers' speeds stacked into one long column (NULLs dropped)."""
    return r.select("event_id", "road_name", "reading_date",
                    F.explode(F.array(F.struct(F.lit("a").alias("provider"), F.col("a_speed").alias("speed")),
                                      F.struct(F.lit("b").alias("provider"), F.col("b_speed").alias("speed"))))
                    .alias("_p")) \
        .select("event_id", "road_name", "reading_date", "_p.provider", "_p.speed") \
        .where(F.col("speed").isNotNull())
