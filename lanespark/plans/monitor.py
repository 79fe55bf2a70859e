"""Monitoring queries over raw readings (binding ``raw_readings``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traffic as T
from ..functions.numeric import rnd, sql_rnd as R
from ..operators import monitor as M
from ..sources import bindings as B
from .registry import register


def rr(spark, sf):
    return B.raw_readings(spark, sf)


def RW(sql: str, *more: str) -> str:
    return B.with_bindings(sql, "raw_readings", *more)


def RWX(text: str, *more: str) -> str:
    ctes = [B.ORACLE_CTE[n].strip() for n in ("raw_readings", *more)]
    return "WITH " + ",\n".join(ctes) + ",\n" + text.strip()


CYCLE = ("strftime(reading_ts, '%Y-%m-%d %H:') || "
         "lpad(CAST(CAST(floor(minute(reading_ts) / 15) * 15 AS INT) AS VARCHAR), 2, '0')")
TS_TEXT = "strftime(reading_ts, '%Y-%m-%d %H:%M:%S')"


def ts_text(c="reading_ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _cong_band_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN {x} < 20 THEN 'Free Flow' WHEN {x} < 40 THEN 'Light' "
            f"WHEN {x} < 60 THEN 'Moderate' WHEN {x} < 80 THEN 'Heavy' ELSE 'Severe' END")


def _cong_color_sql(x):
    return (f"CASE WHEN {x} IS NULL THEN '#95a5a6' WHEN {x} < 20 THEN '#27ae60' WHEN {x} < 40 THEN '#f1c40f' "
            f"WHEN {x} < 60 THEN '#e67e22' WHEN {x} < 80 THEN '#e74c3c' ELSE '#8e44ad' END")


def _cong_pct_sql(v, vf):
    return (f"CASE WHEN {v} IS NOT NULL AND {vf} IS NOT NULL AND {vf} > 0 "
            f"THEN {R(f'(1.0e0 - least({v} / {vf}, 1.0e0)) * 100.0e0', 1)} END")


def _jam_sql(v, vf):
    return (f"CASE WHEN {v} IS NOT NULL AND {vf} IS NOT NULL AND {vf} > 0 "
            f"THEN {R(f'(1.0e0 - least({v} / {vf}, 1.0e0)) * 10.0e0', 2)} END")


@register("scan_raw", RW(f"""
SELECT event_id, {TS_TEXT} AS reading_time, reading_date, reading_hour, road_name, area_name, a_speed,
       a_free_flow, a_travel_time, a_free_flow_time, confidence, b_speed, b_free_flow, jam_factor,
       weather_main, temperature_c, humidity_pct, wind_speed_ms, visibility_m, rain_1h_mm,
       incident_count, has_construction, road_closure, collection_status FROM raw_readings"""))
def q_scan_raw(spark, sf):
    """SRC-03: typed raw readings (timestamp shown as text for a portable compare)."""
    r = rr(spark, sf)
    return r.select("event_id", ts_text().alias("reading_time"), *[c for c in r.columns if c not in ("event_id", "reading_ts")])


@register("collection_history", RW(f"""
SELECT {CYCLE} AS cycle, count(road_name) AS roads, {R('avg(a_speed)', 1)} AS avg_speed,
       count(*) FILTER (WHERE collection_status = 'success') AS successes
FROM raw_readings GROUP BY 1"""), headline=True)
def q_collection_history(spark, sf):
    """AG-23."""
    return M.collection_history(rr(spark, sf))


@register("running_success", RW(f"""
SELECT cycle, successes, CAST(sum(successes) OVER w AS BIGINT) AS total_success, count(*) OVER w AS collections,
       {R('sum(successes) OVER w * 100.0e0 / (count(*) OVER w * 16.0e0)', 4)} AS success_rate
FROM (SELECT {CYCLE} AS cycle, count(*) FILTER (WHERE collection_status = 'success') AS successes
      FROM raw_readings GROUP BY 1)
WINDOW w AS (ORDER BY cycle ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_running_success(spark, sf):
    """WN-12."""
    return M.running_success(rr(spark, sf))


@register("speed_timeline", RW(f"""
SELECT {CYCLE} AS cycle, {R('avg(a_speed)', 4)} AS avg_speed, {R('avg(a_free_flow)', 4)} AS avg_free_flow
FROM raw_readings GROUP BY 1"""))
def q_speed_timeline(spark, sf):
    """AG-24."""
    return M.with_cycle(rr(spark, sf)).groupBy("cycle").agg(
        rnd(F.avg("a_speed"), 4).alias("avg_speed"), rnd(F.avg("a_free_flow"), 4).alias("avg_free_flow"))


@register("road_speed", RW(f"""
SELECT road_name, {R('avg(a_speed)', 4)} AS avg_speed,
       CASE WHEN avg(a_speed) < 20 THEN '#e74c3c' WHEN avg(a_speed) < 30 THEN '#f39c12' ELSE '#27ae60' END AS speed_color
FROM raw_readings WHERE road_name IS NOT NULL GROUP BY 1"""))
def q_road_speed(spark, sf):
    """AG-25 + PRJ-17 speed band."""
    g = rr(spark, sf).where(F.col("road_name").isNotNull()).groupBy("road_name").agg(F.avg("a_speed").alias("_s"))
    return g.select("road_name", rnd("_s", 4).alias("avg_speed"),
                    T.band("_s", T.SPEED_BAND_BOUNDS, T.SPEED_BAND_COLORS, T.SPEED_BAND_COLORS[-1]).alias("speed_color"))


@register("area_jam", RW(f"""
SELECT area_name, {R('avg(jam_factor)', 4)} AS avg_jam, {_cong_color_sql('avg(jam_factor) * 10')} AS jam_color
FROM raw_readings WHERE area_name IS NOT NULL GROUP BY 1"""))
def q_area_jam(spark, sf):
    """AG-26."""
    g = rr(spark, sf).where(F.col("area_name").isNotNull()).groupBy("area_name").agg(F.avg("jam_factor").alias("_j"))
    return g.select("area_name", rnd("_j", 4).alias("avg_jam"), T.congestion_color(F.col("_j") * 10).alias("jam_color"))


@register("hourly_pattern", RW(f"""
SELECT reading_hour, {R('avg(a_speed)', 4)} AS avg_speed FROM raw_readings
WHERE reading_hour IS NOT NULL GROUP BY 1"""))
def q_hourly_pattern(spark, sf):
    """AG-27."""
    return rr(spark, sf).where(F.col("reading_hour").isNotNull()).groupBy("reading_hour") \
        .agg(rnd(F.avg("a_speed"), 4).alias("avg_speed"))


@register("weather_speed", RW(f"""
SELECT weather_main, {R('avg(a_speed)', 4)} AS avg_speed, count(a_speed) AS count
FROM raw_readings WHERE weather_main IS NOT NULL GROUP BY 1 HAVING count(a_speed) >= 5"""))
def q_weather_speed(spark, sf):
    """AG-28 + FLT-05 (HAVING count >= 5)."""
    g = rr(spark, sf).where(F.col("weather_main").isNotNull()).groupBy("weather_main").agg(
        rnd(F.avg("a_speed"), 4).alias("avg_speed"), F.count("a_speed").alias("count"))
    return g.where(F.col("count") >= M.MIN_WEATHER_GROUP)


@register("records_per_day", RW(f"""
SELECT reading_date, count(*) AS records, {R('count(*) * 100.0e0 / 1536.0e0', 4)} AS pct_of_expected
FROM raw_readings WHERE reading_date IS NOT NULL GROUP BY 1"""))
def q_records_per_day(spark, sf):
    """AG-29 (per day)."""
    expected = M.ROADS_PER_CYCLE * M.CYCLES_PER_DAY
    return rr(spark, sf).where(F.col("reading_date").isNotNull()).groupBy("reading_date").agg(
        F.count(F.lit(1)).alias("records"),
        rnd(F.count(F.lit(1)) * F.lit(100.0) / F.lit(float(expected)), 4).alias("pct_of_expected"))


@register("records_per_day_summary", RW(f"""
SELECT {R('avg(n)', 4)} AS mean_records, min(n) AS min_records, max(n) AS max_records, 1536 AS expected
FROM (SELECT reading_date, count(*) AS n FROM raw_readings WHERE reading_date IS NOT NULL GROUP BY 1)"""))
def q_records_per_day_summary(spark, sf):
    """AG-29 (two-level aggregation: per day, then over days)."""
    per_day = rr(spark, sf).where(F.col("reading_date").isNotNull()).groupBy("reading_date") \
        .agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(rnd(F.avg("n"), 4).alias("mean_records"), F.min("n").alias("min_records"),
                       F.max("n").alias("max_records"),
                       F.lit(M.ROADS_PER_CYCLE * M.CYCLES_PER_DAY).alias("expected"))


@register("road_success_rate", RW(f"""
SELECT road_name, {R("avg(CASE WHEN collection_status = 'success' THEN 100.0e0 ELSE 0.0e0 END)", 4)} AS success_pct,
       CASE WHEN avg(CASE WHEN collection_status = 'success' THEN 100.0e0 ELSE 0.0e0 END) > 90 THEN '#27ae60'
            WHEN avg(CASE WHEN collection_status = 'success' THEN 100.0e0 ELSE 0.0e0 END) > 70 THEN '#f39c12'
            ELSE '#e74c3c' END AS success_color
FROM raw_readings WHERE road_name IS NOT NULL GROUP BY 1"""))
def q_road_success_rate(spark, sf):
    """AG-30 + PRJ-17 success band."""
    g = rr(spark, sf).where(F.col("road_name").isNotNull()).groupBy("road_name").agg(
        F.avg(F.when(F.col("collection_status") == "success", 100.0).otherwise(0.0)).alias("_p"))
    return g.select("road_name", rnd("_p", 4).alias("success_pct"),
                    T.band_desc("_p", T.SUCCESS_BAND_BOUNDS, T.SUCCESS_BAND_COLORS).alias("success_color"))


@register("collection_kpis", RW(f"""
SELECT count(*) AS records, count(DISTINCT {CYCLE}) AS cycles, count(DISTINCT reading_date) AS days,
       count(DISTINCT road_name) AS roads,
       {R("count(*) FILTER (WHERE collection_status = 'success') * 100.0e0 / count(*)", 4)} AS success_pct,
       strftime(min(reading_ts), '%Y-%m-%d %H:%M:%S') AS first_reading,
       strftime(max(reading_ts), '%Y-%m-%d %H:%M:%S') AS last_reading,
       count(*) // count(DISTINCT {CYCLE}) AS records_per_cycle
FROM raw_readings"""), headline=True)
def q_collection_kpis(spark, sf):
    """AG-31: all KPIs in one global aggregation."""
    r = M.with_cycle(rr(spark, sf))
    g = r.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("cycle").alias("cycles"),
              F.count_distinct("reading_date").alias("days"), F.count_distinct("road_name").alias("roads"),
              F.count_if(F.col("collection_status") == "success").alias("_ok"),
              F.min("reading_ts").alias("_first"), F.max("reading_ts").alias("_last"))
    return g.select("records", "cycles", "days", "roads",
                    rnd(F.col("_ok") * F.lit(100.0) / F.col("records"), 4).alias("success_pct"),
                    ts_text("_first").alias("first_reading"), ts_text("_last").alias("last_reading"),
                    F.expr("records div cycles").alias("records_per_cycle"))


_LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY road_name
                ORDER BY reading_ts DESC, event_id DESC) AS rn FROM raw_readings WHERE road_name IS NOT NULL)
            WHERE rn = 1)"""
_LATEST_COLS = ["reading_ts", "event_id", "area_name", "a_speed", "a_free_flow", "confidence", "jam_factor",
                "incident_count", "collection_status"]


@register("latest_snapshot", RWX(_LATEST_SQL + f"""
SELECT road_name, {TS_TEXT} AS reading_time, area_name, a_speed, collection_status FROM latest"""))
def q_latest_snapshot(spark, sf):
    """WN-11 per road: newest time by hash aggregate, tie break on the survivors."""
    last = M.latest_per_road(rr(spark, sf), _LATEST_COLS)
    return last.select("road_name", ts_text().alias("reading_time"), "area_name", "a_speed", "collection_status")


@register("newest_snapshot", RWX(f"""
nw AS (SELECT max(reading_ts) AS m FROM raw_readings)
SELECT event_id, road_name, {TS_TEXT} AS reading_time, a_speed, collection_status
FROM raw_readings, nw WHERE reading_ts = m"""))
def q_newest_snapshot(spark, sf):
    """WN-11 whole table: every reading of the newest time."""
    return M.newest_snapshot(rr(spark, sf)).select("event_id", "road_name", ts_text().alias("reading_time"), "a_speed",
                                                   "collection_status")


@register("live_table", RWX(_LATEST_SQL + f"""
SELECT road_name, area_name, a_speed AS current_speed, a_free_flow AS free_flow_speed,
       {_cong_pct_sql('a_speed', 'a_free_flow')} AS congestion_pct, {_jam_sql('a_speed', 'a_free_flow')} AS jam,
       {_cong_band_sql(_cong_pct_sql('a_speed', 'a_free_flow'))} AS band, confidence,
       coalesce(incident_count, 0) AS incidents
FROM latest WHERE collection_status = 'success'"""))
def q_live_table(spark, sf):
    """PRJ-28 over the per-road latest snapshot."""
    last = M.latest_per_road(rr(spark, sf), _LATEST_COLS).where(F.col("collection_status") == "success")
    pct = T.congestion_pct("a_speed", "a_free_flow")
    return last.select("road_name", "area_name", F.col("a_speed").alias("current_speed"),
                       F.col("a_free_flow").alias("free_flow_speed"), rnd(pct, 1).alias("congestion_pct"),
                       rnd(T.jam_factor("a_speed", "a_free_flow"), 2).alias("jam"),
                       T.congestion_band(rnd(pct, 1)).alias("band"), "confidence",
                       F.coalesce("incident_count", F.lit(0)).alias("incidents"))


@register("live_kpis", RWX(_LATEST_SQL + f"""
SELECT count(*) AS n_live, {R('avg(a_speed)', 4)} AS mean_speed,
       {R('avg(' + _cong_pct_sql('a_speed', 'a_free_flow') + ')', 4)} AS mean_congestion,
       {R('avg(a_free_flow)', 4)} AS mean_free_flow
FROM latest WHERE collection_status = 'success'"""))
def q_live_kpis(spark, sf):
    """AG-32."""
    last = M.latest_per_road(rr(spark, sf), _LATEST_COLS).where(F.col("collection_status") == "success")
    return last.agg(F.count(F.lit(1)).alias("n_live"), rnd(F.avg("a_speed"), 4).alias("mean_speed"),
                    rnd(F.avg(rnd(T.congestion_pct("a_speed", "a_free_flow"), 1)), 4).alias("mean_congestion"),
                    rnd(F.avg("a_free_flow"), 4).alias("mean_free_flow"))


@register("map_live", RWX(_LATEST_SQL + f"""
SELECT d.road_name, d.lanes, d.max_capacity_vph, l.a_speed AS current_speed,
       {_cong_pct_sql('l.a_speed', 'l.a_free_flow')} AS congestion_pct,
       CASE WHEN l.collection_status = 'success' AND {_cong_pct_sql('l.a_speed', 'l.a_free_flow')} IS NOT NULL THEN
            CASE WHEN {_cong_pct_sql('l.a_speed', 'l.a_free_flow')} < 30 THEN 'green'
                 WHEN {_cong_pct_sql('l.a_speed', 'l.a_free_flow')} < 60 THEN 'orange' ELSE 'red' END
            ELSE 'gray' END AS map_color
FROM road_dim d LEFT JOIN latest l ON l.road_name = d.road_name""", "road_dim"))
def q_map_live(spark, sf):
    """JN-07: every road of the dimension with its latest reading (unmatched kept)."""
    last = M.latest_per_road(rr(spark, sf), _LATEST_COLS)
    j = B.road_dim(spark, sf).join(last, "road_name", "left")
    pct = rnd(T.congestion_pct("a_speed", "a_free_flow"), 1)
    color = F.when((F.col("collection_status") == "success") & pct.isNotNull(),
                   T.band(pct, T.MAP_BAND_BOUNDS, T.MAP_BAND_COLORS, "gray")).otherwise("gray")
    return j.select("road_name", "lanes", "max_capacity_vph", F.col("a_speed").alias("current_speed"),
                    pct.alias("congestion_pct"), color.alias("map_color"))


_COMPLETE = ["a_speed", "b_speed", "jam_factor", "weather_main", "temperature_c"]


@register("completeness", RW("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, {R(f'count({c}) * 100.0e0 / count(*)', 4)} AS pct FROM raw_readings"
    for c in _COMPLETE)))
def q_completeness(spark, sf):
    """AG-33: one scan, unpivoted after aggregation."""
    r = rr(spark, sf)
    one = r.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in _COMPLETE])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).alias("non_null"),
        rnd(F.col(c) * F.lit(100.0) / F.col("_n"), 4).alias("pct")) for c in _COMPLETE])).alias("_s")).select("_s.*")


@register("status_distribution", RW(f"""
SELECT collection_status, count(*) AS count, {R('count(*) * 100.0e0 / sum(count(*)) OVER ()', 4)} AS pct
FROM raw_readings WHERE collection_status IS NOT NULL GROUP BY 1"""))
def q_status_distribution(spark, sf):
    """AG-34."""
    from ..operators.profile import value_counts
    return value_counts(rr(spark, sf), "collection_status")


@register("sql_functions", RW(f"""
SELECT event_id, {_jam_sql('a_speed', 'a_free_flow')} AS jam, {_cong_band_sql('a_speed')} AS band,
       CASE WHEN lower(weather_main) IN ('rain', 'drizzle', 'thunderstorm') THEN 'Rain'
            WHEN lower(weather_main) IN ('mist', 'fog', 'haze', 'smoke') THEN 'Fog'
            WHEN lower(weather_main) IN ('squall', 'tornado') THEN 'Windy' ELSE 'Clear' END AS weather,
       CAST(CASE WHEN has_construction THEN 1 ELSE 0 END AS INT) AS roadwork FROM raw_readings"""))
def q_sql_functions(spark, sf):
    """The scalar functions as SQL users call them."""
    T.register_sql_functions(spark)
    return rr(spark, sf).selectExpr(
        "event_id", "jam_factor(a_speed, a_free_flow) AS jam", "congestion_band(a_speed) AS band",
        "map_weather(weather_main) AS weather", "yes_flag(IF(has_construction, 'Yes', 'No')) AS roadwork")


@register("jam_factor", RW(f"""
SELECT event_id, {_jam_sql('a_speed', 'a_free_flow')} AS jam, {_cong_pct_sql('a_speed', 'a_free_flow')} AS congestion_pct
FROM raw_readings"""))
def q_jam_factor(spark, sf):
    """PRJ-13."""
    r = rr(spark, sf)
    return r.select("event_id", rnd(T.jam_factor("a_speed", "a_free_flow"), 2).alias("jam"),
                    rnd(T.congestion_pct("a_speed", "a_free_flow"), 1).alias("congestion_pct"))


@register("congestion_band", RW(f"""
SELECT event_id, {_cong_pct_sql('a_speed', 'a_free_flow')} AS congestion_pct,
       {_cong_band_sql(_cong_pct_sql('a_speed', 'a_free_flow'))} AS band,
       {_cong_color_sql(_cong_pct_sql('a_speed', 'a_free_flow'))} AS color
FROM raw_readings"""))
def q_congestion_band(spark, sf):
    """PRJ-16."""
    pct = rnd(T.congestion_pct("a_speed", "a_free_flow"), 1)
    return rr(spark, sf).select("event_id", pct.alias("congestion_pct"), T.congestion_band(pct).alias("band"),
                                T.congestion_color(pct).alias("color"))


@register("collection_status", RW("""
SELECT event_id, CASE WHEN a_speed IS NOT NULL AND b_speed IS NOT NULL AND weather_main IS NOT NULL THEN 'success'
                      WHEN a_speed IS NOT NULL OR b_speed IS NOT NULL OR weather_main IS NOT NULL THEN 'partial'
                      ELSE 'failed' END AS derived_status
FROM raw_readings"""))
def q_collection_status(spark, sf):
    """PRJ-14: success if every source answered, partial if any did."""
    r = rr(spark, sf)
    return r.select("event_id", T.collection_status(F.col("a_speed").isNotNull(), F.col("b_speed").isNotNull(),
                                                    F.col("weather_main").isNotNull()).alias("derived_status"))


@register("traversability", RW("""
SELECT event_id, CASE WHEN coalesce(road_closure, false) THEN 'closed' ELSE 'open' END AS traversability
FROM raw_readings"""))
def q_traversability(spark, sf):
    """PRJ-15."""
    return rr(spark, sf).select("event_id", T.traversability("road_closure").alias("traversability"))


@register("map_weather", RW("""
SELECT event_id, weather_main,
       CASE WHEN lower(weather_main) IN ('rain', 'drizzle', 'thunderstorm') THEN 'Rain'
            WHEN lower(weather_main) IN ('mist', 'fog', 'haze', 'smoke') THEN 'Fog'
            WHEN lower(weather_main) IN ('squall', 'tornado') THEN 'Windy' ELSE 'Clear' END AS weather
FROM raw_readings"""))
def q_map_weather(spark, sf):
    """PRJ-21 (per reading)."""
    return rr(spark, sf).select("event_id", "weather_main", T.map_weather("weather_main").alias("weather"))


@register("incident_sampling", RW("""
SELECT event_id, CASE WHEN minute(reading_ts) < 15 THEN incident_count ELSE 0 END AS incident_count,
       CASE WHEN minute(reading_ts) < 15 THEN has_construction ELSE false END AS has_construction,
       CASE WHEN minute(reading_ts) < 15 THEN 'fetched' ELSE 'skipped' END AS incident_status
FROM raw_readings"""))
def q_incident_sampling(spark, sf):
    """PRJ-30 (dashboard rule: minute < 15)."""
    return M.incident_sampling(rr(spark, sf))


_DISPLAY_SQL = ", ".join(
    f'{TS_TEXT if k == "reading_ts" else k} AS "{v}"' for k, v in M.DISPLAY_NAMES.items()
    if k not in ("lanes", "max_capacity_vph"))


@register("rename_display", RW(f"SELECT {_DISPLAY_SQL} FROM raw_readings"))
def q_rename_display(spark, sf):
    """PRJ-22."""
    r = rr(spark, sf).withColumn("reading_ts", ts_text())
    return M.rename_display(r.select(*[c for c in M.DISPLAY_NAMES if c in r.columns]))


@register("facet_filter", RW("""
SELECT event_id, road_name, area_name, reading_date, a_speed FROM raw_readings
WHERE area_name = 'Area 3' AND reading_date = DATE '2024-01-15'"""))
def q_facet_filter(spark, sf):
    """FLT-02: date and area chosen, road = 'All'."""
    r = M.facet_filter(rr(spark, sf), date="2024-01-15", area="Area 3", road="All")
    return r.select("event_id", "road_name", "area_name", "reading_date", "a_speed")


@register("successful_only", RW("""
SELECT event_id, road_name, a_speed FROM raw_readings WHERE collection_status = 'success'"""))
def q_successful_only(spark, sf):
    """FLT-03."""
    return rr(spark, sf).where(F.col("collection_status") == "success").select("event_id", "road_name", "a_speed")


@register("join_road_dim", RW("""
SELECT r.event_id, r.road_name, coalesce(d.lanes, 4) AS lanes, coalesce(d.max_capacity_vph, 4000) AS max_capacity_vph
FROM raw_readings r LEFT JOIN road_dim d ON d.road_name = r.road_name""", "road_dim"))
def q_join_road_dim(spark, sf):
    """JN-01."""
    r = rr(spark, sf).select("event_id", "road_name")
    return M.join_road_dim(r, B.road_dim(spark, sf))


@register("join_cycle_weather", RWX(f"""
fr AS (SELECT {CYCLE} AS cycle, weather_main AS city_weather, temperature_c AS city_temperature,
              row_number() OVER (PARTITION BY {CYCLE} ORDER BY reading_ts, event_id) AS rn FROM raw_readings)
SELECT r.event_id, r.road_name, w.city_weather, w.city_temperature
FROM raw_readings r JOIN (SELECT * FROM fr WHERE rn = 1) w ON w.cycle = {CYCLE.replace('reading_ts', 'r.reading_ts')}"""))
def q_join_cycle_weather(spark, sf):
    """JN-02: the cycle's first weather reading applied to every road of that cycle."""
    r = M.with_cycle(rr(spark, sf))
    w = M.first_per_cycle(rr(spark, sf), ["weather_main", "temperature_c"]).select(
        "cycle", F.col("weather_main").alias("city_weather"), F.col("temperature_c").alias("city_temperature"))
    return r.select("event_id", "road_name", "cycle").join(w, "cycle").drop("cycle")


@register("pool_providers", RW("""
SELECT event_id, road_name, reading_date, 'a' AS provider, a_speed AS speed FROM raw_readings WHERE a_speed IS NOT NULL
UNION ALL
SELECT event_id, road_name, reading_date, 'b' AS provider, b_speed AS speed FROM raw_readings WHERE b_speed IS NOT NULL"""))
def q_pool_providers(spark, sf):
    """SO-02."""
    return M.pool_providers(rr(spark, sf))


@register("distinct_values", RW("SELECT DISTINCT area_name, road_name FROM raw_readings"))
def q_distinct_values(spark, sf):
    """select.distinct (filter choices)."""
    return rr(spark, sf).select("area_name", "road_name").distinct()


@register("threshold_bands", RW(f"""
SELECT road_name,
       CASE WHEN avg(a_speed) < 20 THEN '#e74c3c' WHEN avg(a_speed) < 30 THEN '#f39c12' ELSE '#27ae60' END AS speed_color,
       CASE WHEN avg(CASE WHEN collection_status = 'success' THEN 100.0e0 ELSE 0.0e0 END) > 90 THEN '#27ae60'
            WHEN avg(CASE WHEN collection_status = 'success' THEN 100.0e0 ELSE 0.0e0 END) > 70 THEN '#f39c12'
            ELSE '#e74c3c' END AS success_color,
       CASE WHEN avg(jam_factor) * 10 < 30 THEN 'green' WHEN avg(jam_factor) * 10 < 60 THEN 'orange' ELSE 'red' END AS map_color
FROM raw_readings WHERE road_name IS NOT NULL GROUP BY 1"""))
def q_threshold_bands(spark, sf):
    """PRJ-17: the generic banding helper applied to three per-road statistics in one aggregation."""
    g = rr(spark, sf).where(F.col("road_name").isNotNull()).groupBy("road_name").agg(
        F.avg("a_speed").alias("_s"), F.avg(F.when(F.col("collection_status") == "success", 100.0).otherwise(0.0)).alias("_p"),
        F.avg("jam_factor").alias("_j"))
    return g.select("road_name",
                    T.band("_s", T.SPEED_BAND_BOUNDS, T.SPEED_BAND_COLORS, T.SPEED_BAND_COLORS[-1]).alias("speed_color"),
                    T.band_desc("_p", T.SUCCESS_BAND_BOUNDS, T.SUCCESS_BAND_COLORS).alias("success_color"),
                    T.band(F.col("_j") * 10, T.MAP_BAND_BOUNDS, T.MAP_BAND_COLORS, T.MAP_BAND_COLORS[-1]).alias("map_color"))


@register("having_min_count", RW(f"""
SELECT weather_main, count(a_speed) AS count FROM raw_readings WHERE weather_main IS NOT NULL
GROUP BY 1 HAVING count(a_speed) >= 5"""))
def q_having_min_count(spark, sf):
    """FLT-05: groups with at least 5 readings (HAVING after the aggregation)."""
    g = rr(spark, sf).where(F.col("weather_main").isNotNull()).groupBy("weather_main").agg(F.count("a_speed").alias("count"))
    return g.where(F.col("count") >= M.MIN_WEATHER_GROUP)
