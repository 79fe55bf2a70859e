"""Ingest queries: raw readings -> daily roll-up, payload parsing, upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import traffic as T
from ..functions.numeric import rnd, sql_rnd
from ..operators import daily as D
from ..operators.split import SQL_DAILY_KEY, sql_arith_hash
from ..sources import bindings as B
from ..sources import payloads as P
from .registry import register

# --- shared oracle fragments --------------------------------------------------
DAILY_ROLLUP_SQL_BODY = """
wc AS (SELECT reading_date, road_name, weather_main, count(*) AS n
       FROM raw_readings WHERE weather_main IS NOT NULL GROUP BY ALL),
wm AS (SELECT reading_date, road_name, weather_main AS wmode FROM (
         SELECT *, row_number() OVER (PARTITION BY reading_date, road_name
                                      ORDER BY n DESC, weather_main) AS rn FROM wc) WHERE rn = 1),
a AS (SELECT reading_date AS traffic_date, road_name, arg_min(area_name, reading_ts) AS area_name,
             coalesce(sum(a_speed), 0.0e0) + coalesce(sum(b_speed), 0.0e0) AS s_v,
             count(a_speed) + count(b_speed) AS n_v,
             coalesce(sum(a_free_flow), 0.0e0) + coalesce(sum(b_free_flow), 0.0e0) AS s_ff,
             count(a_free_flow) + count(b_free_flow) AS n_ff,
             avg(a_travel_time) AS tt, avg(a_free_flow_time) AS tff, avg(jam_factor) AS jam,
             max(incident_count) AS inc, avg(temperature_c) AS temp, avg(humidity_pct) AS hum,
             avg(wind_speed_ms) AS wind, avg(rain_1h_mm) AS rain, avg(visibility_m) AS vis,
             avg(confidence) AS conf, bool_or(coalesce(has_construction, false)) AS work
      FROM raw_readings WHERE road_name IS NOT NULL AND reading_date IS NOT NULL GROUP BY 1, 2),
b AS (SELECT x.*, wm.wmode, coalesce(d.max_capacity_vph, 4000) AS cap,
             CASE WHEN n_v > 0 THEN s_v / n_v END AS v, CASE WHEN n_ff > 0 THEN s_ff / n_ff END AS vf
      FROM a AS x LEFT JOIN wm ON wm.reading_date = x.traffic_date AND wm.road_name = x.road_name
             LEFT JOIN road_dim d ON d.road_name = x.road_name),
c AS (SELECT *, coalesce(v <> 0 AND vf <> 0 AND vf > 0, false) AS sok,
             greatest(0.0e0, least(100.0e0,
               CASE WHEN jam IS NOT NULL THEN (jam / 10.0e0) * 100.0e0
                    WHEN coalesce(v <> 0 AND vf <> 0 AND vf > 0, false) THEN (1.0e0 - v / vf) * 100.0e0
                    ELSE 50.0e0 END)) AS cong,
             CASE WHEN v IS NULL OR vf IS NULL OR vf = 0 THEN
                    CASE WHEN jam IS NULL THEN NULL
                         WHEN jam / 10.0e0 <= 0.5e0 THEN (jam / 10.0e0) * 1.8e0
                         ELSE 1.0e0 - (jam / 10.0e0 - 0.5e0) * 0.4e0 END
                  WHEN least(v / vf, 1.0e0) > 0.9e0 THEN 0.3e0 + 0.2e0 * (1.0e0 - least(v / vf, 1.0e0)) / 0.1e0
                  WHEN least(v / vf, 1.0e0) > 0.5e0 THEN 0.5e0 + 0.5e0 * (0.9e0 - least(v / vf, 1.0e0)) / 0.4e0
                  WHEN least(v / vf, 1.0e0) > 0.2e0 THEN 1.0e0 - 0.3e0 * (0.5e0 - least(v / vf, 1.0e0)) / 0.3e0
                  ELSE 0.7e0 * least(v / vf, 1.0e0) / 0.2e0 END AS flow
      FROM b),
daily AS (
  SELECT traffic_date, area_name, road_name,
         CAST(CASE WHEN flow IS NULL THEN CAST(trunc(cap * 12) AS INT)
                   ELSE greatest(0, CAST(trunc(cap * flow * 24.0e0) AS INT)) END AS INT) AS volume,
         CASE WHEN v IS NOT NULL AND v <> 0 THEN CAST(round(CAST(v AS DECIMAL(38,10)), 2) AS DOUBLE) ELSE 30.0e0 END AS avg_speed,
         CAST(round(CAST(CASE WHEN tt IS NOT NULL AND tff IS NOT NULL THEN least(tt / greatest(tff, 1.0e0), 3.0e0)
                    WHEN coalesce(v <> 0 AND vf <> 0 AND v > 0, false) THEN least(vf / v, 3.0e0)
                    ELSE 1.0e0 END AS DECIMAL(38,10)), 4) AS DOUBLE) AS tti,
         CAST(round(CAST(cong AS DECIMAL(38,10)), 2) AS DOUBLE) AS congestion,
         CAST(round(CAST(CASE WHEN sok THEN greatest(0.0e0, least(100.0e0, (1.0e0 - v / vf) * 100.0e0))
                    ELSE cong END AS DECIMAL(38,10)), 2) AS DOUBLE) AS capacity_util,
         CAST(coalesce(inc, 0) AS INT) AS incidents,
         CASE WHEN wind > 8.0e0 THEN 'Windy' WHEN wmode IS NULL THEN 'Clear'
              WHEN lower(wmode) IN ('rain', 'drizzle', 'thunderstorm') THEN 'Rain'
              WHEN lower(wmode) IN ('mist', 'fog', 'haze', 'smoke') THEN 'Fog'
              WHEN lower(wmode) IN ('squall', 'tornado') THEN 'Windy' ELSE 'Clear' END AS weather,
         CASE WHEN work THEN 'Yes' ELSE 'No' END AS roadwork,
         CAST(round(CAST(temp AS DECIMAL(38,10)), 2) AS DOUBLE) AS temperature, CAST(round(CAST(hum AS DECIMAL(38,10)), 2) AS DOUBLE) AS humidity, CAST(round(CAST(wind AS DECIMAL(38,10)), 2) AS DOUBLE) AS wind_speed,
         coalesce(CAST(round(CAST(rain AS DECIMAL(38,10)), 2) AS DOUBLE), 0.0e0) AS rain, CAST(round(CAST(vis AS DECIMAL(38,10)), 2) AS DOUBLE) AS visibility,
         CASE WHEN vf IS NOT NULL AND vf <> 0 THEN CAST(round(CAST(vf AS DECIMAL(38,10)), 2) AS DOUBLE) END AS free_flow_speed,
         CAST(round(CAST(jam AS DECIMAL(38,10)), 4) AS DOUBLE) AS jam_factor, CAST(round(CAST(conf AS DECIMAL(38,10)), 4) AS DOUBLE) AS confidence
  FROM c)"""


def daily_rollup_oracle(select_sql: str, *extra_ctes: str) -> str:
    """Oracle text: bindings + daily roll-up CTE chain + caller's SELECT."""
    ctes = ",\n".join([B.ORACLE_CTE["raw_readings"].strip(), B.ORACLE_CTE["road_dim"].strip(),
                       DAILY_ROLLUP_SQL_BODY.strip(), *extra_ctes])
    return "WITH " + ctes + "\n" + select_sql


def realtime_daily(spark, sf_dir):
    return D.daily_rollup(B.raw_readings(spark, sf_dir), B.road_dim(spark, sf_dir))


@register("daily_rollup", daily_rollup_oracle("SELECT * FROM daily"), headline=True)
def q_daily_rollup(spark, sf_dir):
    """AG-01: one record per (date, road) from raw readings."""
    return realtime_daily(spark, sf_dir)


@register("daily_banded", daily_rollup_oracle("""
SELECT *, CASE WHEN congestion IS NULL THEN 'Unknown' WHEN congestion < 20 THEN 'Free Flow'
               WHEN congestion < 40 THEN 'Light' WHEN congestion < 60 THEN 'Moderate'
               WHEN congestion < 80 THEN 'Heavy' ELSE 'Severe' END AS congestion_band,
          CASE WHEN congestion IS NULL THEN '#95a5a6' WHEN congestion < 20 THEN '#27ae60'
               WHEN congestion < 40 THEN '#f1c40f' WHEN congestion < 60 THEN '#e67e22'
               WHEN congestion < 80 THEN '#e74c3c' ELSE '#8e44ad' END AS congestion_color
FROM daily"""), headline=True)
def q_daily_banded(spark, sf_dir):
    """Flagship: AG-01 roll-up with PRJ-16 congestion band and colour."""
    d = realtime_daily(spark, sf_dir)
    return d.withColumn("congestion_band", T.congestion_band("congestion")) \
        .withColumn("congestion_color", T.congestion_color("congestion"))


# ---- sub-outputs of the roll-up (Catalyst prunes the aggregates each one does not need) ----
_SUB = {
    "daily_speed": ["avg_speed", "free_flow_speed"],        # AG-01a
    "daily_tti": ["tti"],                                   # AG-01b
    "daily_congestion": ["congestion"],                     # AG-01c
    "daily_capacity": ["capacity_util"],                    # AG-01d
    "daily_volume": ["volume"],                             # AG-01e
    "daily_incidents": ["incidents"],                       # AG-01f
    "daily_weather_means": ["temperature", "humidity", "wind_speed", "rain", "visibility"],  # AG-01g
    "daily_weather_mode": ["weather"],                      # AG-01h
    "daily_roadwork": ["roadwork"],                         # AG-01i
    "daily_sensor": ["free_flow_speed", "jam_factor", "confidence"],  # AG-01j
    "daily_area": ["area_name"],                            # AG-01k
}


def _sub_query(cols):
    def fn(spark, sf_dir):
        return realtime_daily(spark, sf_dir).select("traffic_date", "road_name", *cols)
    return fn


for _k, _cols in _SUB.items():
    register(_k, daily_rollup_oracle(f"SELECT traffic_date, road_name, {', '.join(_cols)} FROM daily"))(_sub_query(_cols))


@register("estimate_volume", daily_rollup_oracle("""
SELECT traffic_date, road_name,
       CASE WHEN flow IS NULL THEN NULL ELSE greatest(0, CAST(trunc(cap * flow * 24.0e0) AS INT)) END AS estimated_volume
FROM c"""))
def q_estimate_volume(spark, sf_dir):
    """PRJ-20 on the daily sufficient statistics (NULL when neither speeds nor jam exist)."""
    agg = D.daily_aggregates(B.raw_readings(spark, sf_dir))
    dim = B.road_dim(spark, sf_dir).select("road_name", "max_capacity_vph")
    j = agg.join(dim, "road_name", "left")
    v = F.when(F.col("_n_v") > 0, F.col("_s_v") / F.col("_n_v"))
    vf = F.when(F.col("_n_ff") > 0, F.col("_s_ff") / F.col("_n_ff"))
    cap = F.coalesce("max_capacity_vph", F.lit(T.DEFAULT_CAPACITY_VPH))
    return j.select("traffic_date", "road_name", T.estimate_volume(v, vf, "_jam", cap).alias("estimated_volume"))


_DAILY_STATS_COLS = ["volume", "avg_speed", "tti", "congestion", "capacity_util", "incidents", "temperature",
                     "humidity", "wind_speed", "rain", "visibility", "free_flow_speed", "jam_factor", "confidence"]


@register("daily_column_stats", daily_rollup_oracle("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {sql_rnd(f'min({c})', 4)} AS min, {sql_rnd(f'avg({c})', 4)} AS mean, "
    f"{sql_rnd(f'max({c})', 4)} AS max FROM daily" for c in _DAILY_STATS_COLS)))
def q_daily_column_stats(spark, sf_dir):
    """AG-35: min/mean/max of 14 daily columns, one aggregation, unpivoted after."""
    d = realtime_daily(spark, sf_dir)
    one = d.agg(*[e for c in _DAILY_STATS_COLS for e in (
        F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.avg(c).alias(f"{c}__mean"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"))])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), rnd(f"{c}__min", 4).alias("min"), rnd(f"{c}__mean", 4).alias("mean"),
        rnd(f"{c}__max", 4).alias("max")) for c in _DAILY_STATS_COLS])).alias("_s")).select("_s.*")


@register("filter_date", daily_rollup_oracle("SELECT * FROM daily WHERE traffic_date = DATE '2024-01-15'"))
def q_filter_date(spark, sf_dir):
    """FLT-01: one date; the predicate is pushed below the aggregation to the readings."""
    return realtime_daily(spark, sf_dir).where(F.col("traffic_date") == F.lit("2024-01-15").cast("date"))


# ---- idempotent date-replacing upsert (SNK-02 / JN-04 / SO-01 / SO-04) ----------
# existing table = roll-up of the morning readings (hour < 12) of every day;
# new batch      = full roll-up of the last seven days present in the readings.

def _prefixed_rollup(src: str, prefix: str) -> str:
    body = DAILY_ROLLUP_SQL_BODY.strip()
    for name in ("wc", "wm", "a", "b", "c", "daily"):
        body = body.replace(f"\n{name} AS (", f"\n{prefix}{name} AS (")
        body = body.replace(f"FROM {name} ", f"FROM {prefix}{name} ").replace(f"FROM {name})", f"FROM {prefix}{name})")
        body = body.replace(f"FROM {name}\n", f"FROM {prefix}{name}\n")
    body = body.replace("wc AS (SELECT", f"{prefix}wc AS (SELECT", 1) if body.startswith("wc AS") else body
    body = body.replace("LEFT JOIN wm ON wm.", f"LEFT JOIN {prefix}wm ON {prefix}wm.") \
        .replace("wm.wmode", f"{prefix}wm.wmode").replace("wm.road_name", f"{prefix}wm.road_name") \
        .replace(f"{prefix}{prefix}", prefix)
    return body.replace("FROM raw_readings", f"FROM {src}")


_UPSERT_CTES = [
    "morning AS (SELECT * FROM raw_readings WHERE reading_hour < 12)",
    "recent AS (SELECT * FROM raw_readings WHERE reading_date > "
    "(SELECT max(reading_date) FROM raw_readings) - 7)",
    _prefixed_rollup("morning", "e_"),
    _prefixed_rollup("recent", "n_"),
]


def _upsert_inputs(spark, sf_dir):
    r = B.raw_readings(spark, sf_dir)
    dim = B.road_dim(spark, sf_dir)
    existing = D.daily_rollup(r.where(F.col("reading_hour") < 12), dim)
    last = r.agg(F.max("reading_date").alias("_last"))  # one row
    recent = r.crossJoin(F.broadcast(last)).where(F.col("reading_date") > F.date_sub("_last", 7)).drop("_last")
    batch = D.daily_rollup(recent, dim)
    return existing, batch


@register("replace_dates", daily_rollup_oracle("""
SELECT * FROM e_daily WHERE traffic_date NOT IN (SELECT traffic_date FROM n_daily)
UNION ALL SELECT * FROM n_daily""", *_UPSERT_CTES))
def q_replace_dates(spark, sf_dir):
    """SNK-02 (query form): drop existing rows of the batch's dates, then union."""
    existing, batch = _upsert_inputs(spark, sf_dir)
    return D.replace_dates(existing, batch)


@register("anti_replaced_dates", daily_rollup_oracle("""
SELECT * FROM e_daily e WHERE NOT EXISTS (SELECT 1 FROM n_daily n WHERE n.traffic_date = e.traffic_date)""",
                                                     *_UPSERT_CTES))
def q_anti_replaced_dates(spark, sf_dir):
    """JN-04: left anti join on date."""
    existing, batch = _upsert_inputs(spark, sf_dir)
    return existing.join(batch.select("traffic_date").distinct(), "traffic_date", "left_anti")


@register("union_daily", daily_rollup_oracle("SELECT * FROM e_daily UNION ALL SELECT * FROM n_daily", *_UPSERT_CTES))
def q_union_daily(spark, sf_dir):
    """SO-01."""
    existing, batch = _upsert_inputs(spark, sf_dir)
    return existing.unionByName(batch, allowMissingColumns=True)


@register("except_dates", daily_rollup_oracle("""
SELECT DISTINCT traffic_date FROM e_daily WHERE traffic_date NOT IN (SELECT traffic_date FROM n_daily)""",
                                              *_UPSERT_CTES))
def q_except_dates(spark, sf_dir):
    """SO-04: dates of the existing table that the batch does not touch."""
    existing, batch = _upsert_inputs(spark, sf_dir)
    return existing.select("traffic_date").distinct().join(batch.select("traffic_date"), "traffic_date", "left_anti")


# ---- payload parsing (SRC-05..09) ---------------------------------------------

def _payloads(spark, sf_dir):
    return P.landed_payloads(B.raw_readings(spark, sf_dir))


@register("parse_flow", B.with_bindings("""
SELECT event_id,
       CASE WHEN a_speed IS NOT NULL THEN a_speed END AS current_speed,
       CASE WHEN a_speed IS NOT NULL THEN a_free_flow END AS free_flow_speed,
       CASE WHEN a_speed IS NOT NULL THEN a_travel_time END AS current_travel_time,
       CASE WHEN a_speed IS NOT NULL THEN a_free_flow_time END AS free_flow_travel_time,
       CASE WHEN a_speed IS NOT NULL THEN confidence END AS confidence_score,
       CASE WHEN a_speed IS NOT NULL THEN coalesce(road_closure, false) END AS road_closed,
       CASE WHEN a_speed IS NOT NULL THEN 'ok' ELSE 'http_503' END AS flow_status
FROM raw_readings""", "raw_readings"))
def q_parse_flow(spark, sf_dir):
    """SRC-05."""
    p = P.parse_flow(_payloads(spark, sf_dir), http_status="http_status")
    return p.select("event_id", "current_speed", "free_flow_speed", "current_travel_time", "free_flow_travel_time",
                    "confidence_score", "road_closed", "flow_status")


@register("parse_jam", B.with_bindings(f"""
SELECT event_id,
       CASE WHEN b_speed IS NOT NULL THEN {sql_rnd('(b_speed / 3.6e0) * 3.6e0', 2)} END AS jam_speed_kmh,
       CASE WHEN b_speed IS NOT NULL THEN {sql_rnd('(b_free_flow / 3.6e0) * 3.6e0', 2)} END AS jam_free_flow_kmh,
       CASE WHEN b_speed IS NOT NULL THEN jam_factor END AS jam_factor_value,
       CASE WHEN b_speed IS NOT NULL THEN (CASE WHEN road_closure THEN 'closed' ELSE 'open' END) END AS traversability,
       CASE WHEN b_speed IS NOT NULL THEN 'ok' ELSE 'no_data' END AS jam_status
FROM raw_readings""", "raw_readings"))
def q_parse_jam(spark, sf_dir):
    """SRC-06."""
    p = P.parse_jam(_payloads(spark, sf_dir))
    return p.select("event_id", "jam_speed_kmh", "jam_free_flow_kmh", "jam_factor_value", "traversability", "jam_status")


@register("parse_weather", B.with_bindings("""
SELECT event_id, coalesce(weather_main, 'Unknown') AS weather_main_parsed,
       coalesce(lower(weather_main), '') AS weather_description,
       temperature_c AS temp_c, humidity_pct AS humidity, wind_speed_ms AS wind_ms, visibility_m AS visibility,
       CASE WHEN rain_1h_mm > 0 THEN rain_1h_mm ELSE 0.0e0 END AS rain_mm
FROM raw_readings""", "raw_readings"))
def q_parse_weather(spark, sf_dir):
    """SRC-07."""
    p = P.parse_weather(_payloads(spark, sf_dir))
    return p.select("event_id", "weather_main_parsed", "weather_description", "temp_c", "humidity", "wind_ms",
                    "visibility", "rain_mm")


@register("parse_incidents", B.with_bindings("""
SELECT event_id,
       CAST(coalesce(incident_count, 0) + CASE WHEN has_construction THEN 1 ELSE 0 END
            + CASE WHEN road_closure THEN 1 ELSE 0 END AS INT) AS n_incidents,
       coalesce(has_construction OR road_closure, false) AS construction,
       coalesce(has_construction, false) AS construction_by_type
FROM raw_readings""", "raw_readings"))
def q_parse_incidents(spark, sf_dir):
    """SRC-08 (type rule and icon-category rule; dashboard variant = type only)."""
    p = P.parse_incidents(_payloads(spark, sf_dir))
    return p.select("event_id", "n_incidents", "construction", "construction_by_type")


@register("incident_bbox", B.with_bindings(f"""
SELECT road_name,
       printf('%.6f', {sql_rnd("lat - 500.0e0 / 111000.0e0", 6)}) || ',' || printf('%.6f', {sql_rnd("lon - 500.0e0 / 111000.0e0", 6)})
       || ',' || printf('%.6f', {sql_rnd("lat + 500.0e0 / 111000.0e0", 6)}) || ',' || printf('%.6f', {sql_rnd("lon + 500.0e0 / 111000.0e0", 6)}) AS bbox
FROM (SELECT DISTINCT road_name, 12.9e0 + CAST(substr(road_name, 6) AS INT) * 0.001e0 AS lat,
             77.5e0 + CAST(substr(road_name, 6) AS INT) * 0.0005e0 AS lon FROM raw_readings)""", "raw_readings"))
def q_incident_bbox(spark, sf_dir):
    """SRC-09: bounding box per road (road coordinates derived from the road number)."""
    roads = B.raw_readings(spark, sf_dir).select("road_name").distinct()
    n = F.substring("road_name", 6, 100).cast("int")
    roads = roads.select("road_name", (F.lit(12.9) + n * F.lit(0.001)).alias("lat"),
                         (F.lit(77.5) + n * F.lit(0.0005)).alias("lon"))
    return roads.select("road_name", P.incident_bbox("lat", "lon", 500.0).alias("bbox"))


@register("road_dim", B.with_bindings("SELECT * FROM road_dim", "road_dim"))
def q_road_dim(spark, sf_dir):
    """SRC-10: the road dimension."""
    return B.road_dim(spark, sf_dir)


# ---- sinks: write, read back (rows-only checks; round-trip tests in tests/) -----------
@register("append_raw")
def q_append_raw(spark, sf_dir):
    """SNK-01: two appends of readings (partitioned by date) read back with partition pruning."""
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    r = B.raw_readings(spark, sf_dir)
    path = scratch(spark, "raw-store")
    K.append_raw(r.where(F.col("reading_hour") < 12), path)
    K.append_raw(r.where(F.col("reading_hour") >= 12), path)
    return spark.read.parquet(path).groupBy("reading_date").agg(F.count(F.lit(1)).alias("records"))


@register("write_processed")
def q_write_processed(spark, sf_dir):
    """SNK-03 + SRC-04: the daily table with its split written once, read back as train/test."""
    from ..operators import split as SP
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    d = B.daily_traffic(spark, sf_dir)
    s = SP.train_test_split(d.withColumn("_h", SP.arith_hash(SP.daily_key(), 42)),
                            ["_h", "traffic_date", "road_name"])
    path = scratch(spark, "processed")
    K.write_processed(s.drop("_h"), path)
    train, test = K.scan_split(spark, path)
    return train.select(F.lit("train").alias("split"), "row_id").unionByName(
        test.select(F.lit("test").alias("split"), "row_id")).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register("export_filtered", B.with_bindings("""
SELECT event_id, road_name AS "Road Name", area_name AS "Area Name", a_speed AS "Current Speed (km/h)",
       collection_status AS "Status" FROM raw_readings WHERE area_name = 'Area 3'""", "raw_readings"))
def q_export_filtered(spark, sf_dir):
    """SNK-06: display-named, filtered readings exported as CSV and read back."""
    from ..operators import monitor as M
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    r = M.facet_filter(B.raw_readings(spark, sf_dir), area="Area 3")
    r = r.select("event_id", "road_name", "area_name", "a_speed", "collection_status")
    path = scratch(spark, "export")
    named = M.rename_display(r)
    K.export_filtered(named, path)
    return spark.read.schema(named.schema).option("header", True).csv(path)


@register("write_metadata", B.with_bindings("""
SELECT area_name AS value, CAST(dense_rank() OVER (ORDER BY area_name) - 1 AS INT) AS code, 'volume' AS target,
       5 AS n_features, n_rows, date_range
FROM (SELECT DISTINCT area_name FROM daily_traffic WHERE area_name IS NOT NULL),
     (SELECT count(*) AS n_rows, concat(CAST(min(traffic_date) AS VARCHAR), ' to ', CAST(max(traffic_date) AS VARCHAR))
             AS date_range FROM daily_traffic)""", "daily_traffic"))
def q_write_metadata(spark, sf_dir):
    """SNK-04: one-row metadata JSON (features, sizes, date range, encoder maps) read back, one row per area code."""
    from ..sources import sinks as K
    from ..streaming.jobs import scratch
    d = B.daily_traffic(spark, sf_dir)
    meta = K.metadata_frame(d, ["avg_speed", "tti", "congestion", "capacity_util", "incidents"], "volume",
                            ["area_name"])
    path = scratch(spark, "metadata")
    K.write_metadata(meta, path)
    back = spark.read.schema(meta.schema).json(path)
    return back.select(F.explode(F.col("encoders")["area_name"]).alias("value", "code"), "target",
                       F.size("features").alias("n_features"), "n_rows", "date_range")


from .registry import ORACLES as _ORACLES  # noqa: E402

_ORACLES["append_raw"] = B.with_bindings(
    "SELECT reading_date, count(*) AS records FROM raw_readings GROUP BY 1", "raw_readings")
_ORACLES["write_processed"] = B.with_bindings(f"""
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS rows FROM (
  SELECT row_number() OVER (ORDER BY h, traffic_date, road_name) <= ceil(count(*) OVER () * 0.3e0) AS is_test
  FROM (SELECT *, {sql_arith_hash(SQL_DAILY_KEY, 42)} AS h FROM daily_traffic))
GROUP BY 1""", "daily_traffic")
