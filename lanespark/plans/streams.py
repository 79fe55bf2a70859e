"""Streaming queries: each lands Spark-derived input files, runs the stream to completion
(availableNow) and returns what the sink holds; batch twins are the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import rnd, sql_rnd as R
from ..sources import bindings as B
from ..sources import payloads as P
from ..streaming import jobs as J
from .ingest import daily_rollup_oracle
from .registry import register


def _landed_readings(spark, sf, name="readings"):
    r = B.raw_readings(spark, sf)
    path = J.scratch(spark, name)
    J.land(r, path, partition="reading_date")
    return path, spark.read.parquet(path).schema


_CYCLE_START = "to_timestamp(floor(epoch(reading_ts) / 900) * 900)"


@register("stream_cycle_15m", B.with_bindings(f"""
SELECT strftime(CAST({_CYCLE_START} AS TIMESTAMP), '%Y-%m-%d %H:%M') AS cycle, road_name, count(*) AS readings,
       {R('avg(a_speed)', 4)} AS avg_speed, max(jam_factor) AS max_jam
FROM raw_readings
WHERE {_CYCLE_START} + INTERVAL 15 MINUTE <= (SELECT max(CAST(reading_ts AS TIMESTAMPTZ)) FROM raw_readings) - INTERVAL 30 MINUTE
GROUP BY 1, 2""", "raw_readings"))
def q_stream_cycle_15m(spark, sf):
    """ST-02: 15-minute tumbling windows per road, watermark 30 min, append mode."""
    path, schema = _landed_readings(spark, sf)
    out = J.stream_cycle_15m(spark, path, J.scratch(spark, "cycle15"), schema)
    return out.select("cycle", "road_name", "readings", rnd("avg_speed", 4).alias("avg_speed"), "max_jam")


@register("stream_dedup", B.with_bindings("""
SELECT event_id, road_name, strftime(reading_ts, '%Y-%m-%d %H:%M:%S') AS reading_time FROM raw_readings""",
                                          "raw_readings"))
def q_stream_dedup(spark, sf):
    """ST-04: the readings landed twice (two writers) -> one row per (timestamp, road)."""
    path, schema = _landed_readings(spark, sf, "readings-a")
    path2, _ = _landed_readings(spark, sf, "readings-b")
    out = J.stream_dedup(spark, [path, path2], J.scratch(spark, "dedup"), schema)
    return out.select("event_id", "road_name", F.date_format("reading_ts", "yyyy-MM-dd HH:mm:ss").alias("reading_time"))


@register("stream_latest", B.with_bindings("""
SELECT road_name, strftime(reading_ts, '%Y-%m-%d %H:%M:%S') AS reading_time, a_speed, collection_status,
       CASE WHEN pct IS NULL THEN 'Unknown' WHEN pct < 20 THEN 'Free Flow' WHEN pct < 40 THEN 'Light'
            WHEN pct < 60 THEN 'Moderate' WHEN pct < 80 THEN 'Heavy' ELSE 'Severe' END AS band
FROM (SELECT *, CASE WHEN a_speed IS NOT NULL AND a_free_flow IS NOT NULL AND a_free_flow > 0
                     THEN """ + R("(1.0e0 - least(a_speed / a_free_flow, 1.0e0)) * 100.0e0", 1) + """ END AS pct,
             row_number() OVER (PARTITION BY road_name ORDER BY reading_ts DESC, event_id DESC) AS rn
      FROM raw_readings WHERE road_name IS NOT NULL) WHERE rn = 1""", "raw_readings"))
def q_stream_latest(spark, sf):
    """ST-06: latest reading and congestion band per road (complete mode, state = one row per road)."""
    path, schema = _landed_readings(spark, sf)
    return J.stream_latest(spark, path, J.scratch(spark, "latest"), schema)


@register("stream_daily", daily_rollup_oracle("SELECT * FROM daily"))
def q_stream_daily(spark, sf):
    """ST-03: replay-safe daily roll-up from mergeable state, touched dates only."""
    path, schema = _landed_readings(spark, sf)
    out = J.stream_daily(spark, path, J.scratch(spark, "daily"), schema, B.road_dim(spark, sf))
    from ..operators.daily import DAILY_COLUMNS
    return out.select(*DAILY_COLUMNS)


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    """ST-01: landed JSON payload documents -> typed rows (equals the batch parse; see tests)."""
    docs = P.landed_payloads(B.raw_readings(spark, sf))
    landed = J.scratch(spark, "landed")
    J.land(docs, landed, fmt="json")
    return J.stream_ingest(spark, landed, J.scratch(spark, "ingest"), docs.schema)


@register("stream_late", B.with_bindings(f"""
SELECT r.reading_date, CAST(count(DISTINCT road_name) AS BIGINT) AS daily_road_days,
       CAST(count_if(r.reading_date <> f.d AND {_CYCLE_START} + INTERVAL 15 MINUTE <= f.m - INTERVAL 30 MINUTE) AS BIGINT)
       AS window_readings
FROM raw_readings r, (SELECT min(reading_date) AS d, max(CAST(reading_ts AS TIMESTAMPTZ)) AS m FROM raw_readings) f
GROUP BY 1""", "raw_readings"))
def q_stream_late(spark, sf):
    """ST-05: the first day's readings arrive after everything else. The 15-minute window job has
    already moved its watermark past them and drops them; the daily job still adds them to
    that day. One row per date: readings kept by the window job vs road-days in the daily table."""
    r = B.raw_readings(spark, sf)
    first = r.agg(F.min("reading_date").alias("d")).first()["d"]  # one value (driver metadata)
    src = J.scratch(spark, "late-src")
    r.where(F.col("reading_date") != F.lit(first)).write.parquet(src)
    schema = spark.read.parquet(src).schema
    win_out, daily_out = J.scratch(spark, "late-win"), J.scratch(spark, "late-daily")
    dim = B.road_dim(spark, sf)
    for late_batch in (False, True):
        if late_batch:  # the late file lands in the same source folder
            r.where(F.col("reading_date") == F.lit(first)).write.mode("append").parquet(src)
        J.stream_cycle_15m(spark, src, win_out, schema)
        J.stream_daily(spark, src, daily_out, schema, dim)
    win = spark.read.parquet(win_out).groupBy(F.substring("cycle", 1, 10).cast("date").alias("reading_date")) \
        .agg(F.sum("readings").alias("window_readings"))
    daily = spark.read.parquet(daily_out).groupBy(F.col("traffic_date").alias("reading_date")) \
        .agg(F.count(F.lit(1)).alias("daily_road_days"))
    return daily.join(win, "reading_date", "left").fillna(0, ["window_readings"])
