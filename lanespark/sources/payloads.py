"""API payload parsing (SRC-05..09): landed JSON text -> typed columns.

Responses are landed as JSON text (one document per row) and parsed with
``from_json`` against explicit schemas — no Python per row. Missing keys
become NULL, defaults are applied with ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import traffic as T
from ..functions.numeric import rnd

FLOW_SCHEMA = ("flowSegmentData STRUCT<currentSpeed: DOUBLE, freeFlowSpeed: DOUBLE, currentTravelTime: DOUBLE, "
               "freeFlowTravelTime: DOUBLE, confidence: DOUBLE, roadClosure: BOOLEAN>")
JAM_SCHEMA = ("results ARRAY<STRUCT<currentFlow: STRUCT<speed: DOUBLE, freeFlow: DOUBLE, jamFactor: DOUBLE, "
              "traversability: STRING>>>")
WEATHER_SCHEMA = ("weather ARRAY<STRUCT<main: STRING, description: STRING>>, main STRUCT<temp: DOUBLE, humidity: DOUBLE>, "
                  "wind STRUCT<speed: DOUBLE>, visibility DOUBLE, rain STRUCT<`1h`: DOUBLE>")
INCIDENTS_SCHEMA = ("incidents ARRAY<STRUCT<type: STRING, properties: STRUCT<iconCategory: INT, delay: DOUBLE, "
                    "magnitudeOfDelay: INT>>>")

# ---- fixed values that must equal the reference's ---------------------------
MS_TO_KMH = 3.6
WEATHER_UNKNOWN = "Unknown"
DEGREES_PER_METRE = 1.0 / 111000.0
# -----------------------------------------------------------------------------


def parse_flow(df: DataFrame, col: str = "flow_json", http_status: str | None = None) -> DataFrame:
    """SRC-05: flow segment fields; ``roadClosure`` defaults to false; HTTP error -> all NULL."""
    p = F.from_json(F.col(col), FLOW_SCHEMA)["flowSegmentData"]
    ok = F.lit(True) if http_status is None else (F.col(http_status) == 200)

    def g(field):
        return F.when(ok, p[field])

    status = F.lit("ok") if http_status is None else \
        F.when(ok, "ok").otherwise(F.concat(F.lit("http_"), F.col(http_status).cast("string")))
    return df.select("*", g("currentSpeed").alias("current_speed"), g("freeFlowSpeed").alias("free_flow_speed"),
                     g("currentTravelTime").alias("current_travel_time"),
                     g("freeFlowTravelTime").alias("free_flow_travel_time"), g("confidence").alias("confidence_score"),
                     F.when(ok, F.coalesce(p["roadClosure"], F.lit(False))).alias("road_closed"),
                     status.alias("flow_status"))


def parse_jam(df: DataFrame, col: str = "jam_json") -> DataFrame:
    """SRC-06: first result's current flow; m/s -> km/h (2 dp); empty list -> 'no_data'."""
    res = F.from_json(F.col(col), JAM_SCHEMA)["results"]
    first = F.get(res, 0)["currentFlow"]
    has = F.coalesce(F.size(res), F.lit(0)) > 0
    return df.select("*",
                     F.when(has, rnd(first["speed"] * F.lit(MS_TO_KMH), 2)).alias("jam_speed_kmh"),
                     F.when(has, rnd(first["freeFlow"] * F.lit(MS_TO_KMH), 2)).alias("jam_free_flow_kmh"),
                     F.when(has, first["jamFactor"]).alias("jam_factor_value"),
                     F.when(has, F.coalesce(first["traversability"], F.lit("open"))).alias("traversability"),
                     F.when(has, "ok").otherwise("no_data").alias("jam_status"))


def parse_weather(df: DataFrame, col: str = "weather_json") -> DataFrame:
    """SRC-07: ``weather[0].main`` default 'Unknown'; description default ''; missing/0 rain -> 0."""
    p = F.from_json(F.col(col), WEATHER_SCHEMA)
    w0 = F.get(p["weather"], 0)
    rain = p["rain"]["1h"]
    return df.select("*",
                     F.coalesce(w0["main"], F.lit(WEATHER_UNKNOWN)).alias("weather_main_parsed"),
                     F.coalesce(w0["description"], F.lit("")).alias("weather_description"),
                     p["main"]["temp"].alias("temp_c"), p["main"]["humidity"].alias("humidity"),
                     p["wind"]["speed"].alias("wind_ms"), p["visibility"].alias("visibility"),
                     F.when(T.truthy(rain), rain).otherwise(F.lit(0.0)).alias("rain_mm"))


def parse_incidents(df: DataFrame, col: str = "incidents_json") -> DataFrame:
    """SRC-08: incident count; construction if any type or icon category says so.

    ``construction_by_type`` is the dashboard variant that checks the type only.
    """
    inc = F.from_json(F.col(col), INCIDENTS_SCHEMA)["incidents"]
    types = F.array(*[F.lit(t) for t in T.CONSTRUCTION_TYPES])
    icons = F.array(*[F.lit(i) for i in T.CONSTRUCTION_ICONS])
    by_type = F.exists(inc, lambda x: F.array_contains(types, x["type"]))
    by_any = F.exists(inc, lambda x: F.array_contains(types, x["type"])
                      | F.coalesce(F.array_contains(icons, x["properties"]["iconCategory"]), F.lit(False)))
    return df.select("*", F.coalesce(F.size(inc), F.lit(0)).cast("int").alias("n_incidents"),
                     F.coalesce(by_any, F.lit(False)).alias("construction"),
                     F.coalesce(by_type, F.lit(False)).alias("construction_by_type"))


def incident_bbox(lat, lon, radius_m: float = 500.0, digits: int = 6) -> Column:
    """SRC-09: 'lat-d,lon-d,lat+d,lon+d' with d = radius / 111000 degrees."""
    la = F.col(lat) if isinstance(lat, str) else lat
    lo = F.col(lon) if isinstance(lon, str) else lon
    d = F.lit(radius_m * DEGREES_PER_METRE)
    fmt = f"%.{digits}f"
    parts = [rnd(la - d, digits), rnd(lo - d, digits), rnd(la + d, digits), rnd(lo + d, digits)]
    return F.concat_ws(",", *[F.format_string(fmt, p) for p in parts])


def landed_payloads(raw: DataFrame) -> DataFrame:
    """Land API-shaped JSON documents built from typed readings (what a collector would store)."""
    flow = F.to_json(F.struct(F.struct(
        F.col("a_speed").alias("currentSpeed"), F.col("a_free_flow").alias("freeFlowSpeed"),
        F.col("a_travel_time").alias("currentTravelTime"), F.col("a_free_flow_time").alias("freeFlowTravelTime"),
        F.col("confidence").alias("confidence"),
        F.when(F.col("road_closure"), F.lit(True)).alias("roadClosure")).alias("flowSegmentData")))
    cur = F.struct(F.struct((F.col("b_speed") / F.lit(MS_TO_KMH)).alias("speed"),
                            (F.col("b_free_flow") / F.lit(MS_TO_KMH)).alias("freeFlow"),
                            F.col("jam_factor").alias("jamFactor"),
                            F.when(F.col("road_closure"), F.lit("closed")).alias("traversability"))
                   .alias("currentFlow"))
    jam = F.to_json(F.struct(F.when(F.col("b_speed").isNotNull(), F.array(cur))
                             .otherwise(F.array_repeat(cur, 0)).alias("results")))
    weather = F.to_json(F.struct(
        F.when(F.col("weather_main").isNotNull(),
               F.array(F.struct(F.col("weather_main").alias("main"),
                                F.lower("weather_main").alias("description")))).alias("weather"),
        F.struct(F.col("temperature_c").alias("temp"), F.col("humidity_pct").alias("humidity")).alias("main"),
        F.struct(F.col("wind_speed_ms").alias("speed")).alias("wind"),
        F.col("visibility_m").alias("visibility"),
        F.when(F.col("rain_1h_mm") > 0, F.struct(F.col("rain_1h_mm").alias("1h"))).alias("rain")))
    n_acc = F.coalesce(F.col("incident_count"), F.lit(0))
    accident = F.struct(F.lit("ACCIDENT").alias("type"),
                        F.struct(F.lit(1).alias("iconCategory"), F.lit(60.0).alias("delay"),
                                 F.lit(1).alias("magnitudeOfDelay")).alias("properties"))
    roadwork = F.struct(F.lit("ROAD_WORK").alias("type"),
                        F.struct(F.lit(9).alias("iconCategory"), F.lit(120.0).alias("delay"),
                                 F.lit(2).alias("magnitudeOfDelay")).alias("properties"))
    closure = F.struct(F.lit("UNKNOWN").alias("type"),
                       F.struct(F.lit(8).alias("iconCategory"), F.lit(0.0).alias("delay"),
                                F.lit(4).alias("magnitudeOfDelay")).alias("properties"))
    empty = F.array_repeat(accident, 0)
    incidents = F.concat(F.array_repeat(accident, n_acc.cast("int")),
                         F.when(F.coalesce("has_construction", F.lit(False)), F.array(roadwork)).otherwise(empty),
                         F.when(F.coalesce("road_closure", F.lit(False)), F.array(closure)).otherwise(empty))
    inc = F.to_json(F.struct(incidents.alias("incidents")))
    status = F.when(F.col("a_speed").isNull(), F.lit(503)).otherwise(F.lit(200))
    return raw.select("event_id", "road_name", status.alias("http_status"), flow.alias("flow_json"),
                      jam.alias("jam_json"), weather.alias("weather_json"), inc.alias("incidents_json"))
