"""Structured Streaming jobs (ST-01..07).

The reference polls APIs every 15 minutes and appends to a file; here the
landed documents / readings are a file source and each job is a streaming
query. Every job runs with ``trigger(availableNow=True)`` in tests and on a
schedule in production; checkpoints and sinks live under the shared folder
named by ``spark.checkpoint.dir`` so a restarted driver resumes exactly.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import traffic as T
from ..operators import daily as D
from ..operators.metrics import regression_metrics
from ..session import ensure_checkpoint_dir
from ..sources import payloads as P

WATERMARK = "30 minutes"
CYCLE = "15 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:10]}")


def event_time(df: DataFrame, col: str = "reading_ts", out: str = "event_ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): reinterpret the local wall clock."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


def land(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = None) -> str:
    w = df.write.mode("overwrite").format(fmt)
    if partition:
        w = w.partitionBy(partition)
    w.save(path)
    return path


def _files(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream over the files of a folder; ``max_files`` bounds a micro-batch."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def run_available_now(query_builder, checkpoint: str):
    q = query_builder.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---- ST-01: landed payload documents -> typed raw rows ---------------------------------
def stream_ingest(spark: SparkSession, landed_dir: str, out_dir: str, schema) -> DataFrame:
    src = spark.readStream.schema(schema).json(landed_dir)
    parsed = P.parse_incidents(P.parse_weather(P.parse_jam(P.parse_flow(src, http_status="http_status"))))
    typed = parsed.select("event_id", "road_name", "current_speed", "free_flow_speed", "current_travel_time",
                          "free_flow_travel_time", "confidence_score", "road_closed", "jam_speed_kmh",
                          "jam_factor_value", "weather_main_parsed", "temp_c", "wind_ms", "rain_mm",
                          "n_incidents", "construction")
    run_available_now(typed.writeStream.format("parquet").option("path", out_dir), out_dir + "._ckpt")
    return spark.read.parquet(out_dir)


# ---- ST-02: 15-minute tumbling statistics per road (append, watermark) -----------------
def cycle_stats(stream: DataFrame) -> DataFrame:
    s = event_time(stream).withWatermark("event_ts", WATERMARK)
    g = s.groupBy(F.window("event_ts", CYCLE).alias("w"), "road_name").agg(
        F.count(F.lit(1)).alias("readings"), F.avg("a_speed").alias("avg_speed"),
        F.max("jam_factor").alias("max_jam"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("cycle"), "road_name", "readings",
                    "avg_speed", "max_jam")


def stream_cycle_15m(spark: SparkSession, readings_dir: str, out_dir: str, schema,
                     max_files: int | None = None) -> DataFrame:
    src = _files(spark, readings_dir, schema, max_files)
    run_available_now(cycle_stats(src).writeStream.outputMode("append").format("parquet").option("path", out_dir),
                      out_dir + "._ckpt")
    return spark.read.parquet(out_dir)


# ---- ST-03: replay-safe daily roll-up (mergeable state, touched dates only) --------------
def upsert_daily(batch: DataFrame, batch_id: int, state_dir: str, daily_dir: str, road_dim: DataFrame | None) -> None:
    """Add one micro-batch to the daily table.

    The batch's partial statistics go to the state table's partitions of
    (date, batch); a batch that is run again writes the same partitions again.
    The days it touched are then made anew from all batches' partial rows of
    those dates and replace their partitions of the daily table. Neither
    stored readings nor other dates' state are read.
    """
    spark = batch.sparkSession

    def replace(rows: DataFrame, path: str, *partitions: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)

    parts = D.daily_partials(batch).withColumn("_batch", F.lit(batch_id).cast("long"))
    replace(parts, state_dir, "traffic_date", "_batch")
    state = spark.read.schema(parts.schema).parquet(state_dir)
    # one value for each date in the batch, from the names of the partitions
    dates = [r[0] for r in state.where(F.col("_batch") == batch_id).select("traffic_date").distinct().collect()]
    touched = D.merge_partials(state.where(F.col("traffic_date").isin(dates)))
    replace(D.daily_finalize(touched, road_dim), daily_dir, "traffic_date")


def stream_daily(spark: SparkSession, readings_dir: str, daily_dir: str, schema, road_dim: DataFrame | None,
                 max_files: int | None = None):
    """Each micro-batch merges its readings into the days it touches (``upsert_daily``): late rows
    are counted when they come, replays are idempotent by batch id. The state lies beside the
    daily table and belongs to the same checkpoint."""
    run_available_now(_files(spark, readings_dir, schema, max_files).writeStream.foreachBatch(
        lambda batch, batch_id: upsert_daily(batch, batch_id, daily_dir + "._state", daily_dir, road_dim)),
        daily_dir + "._ckpt")
    return spark.read.parquet(daily_dir)


# ---- ST-04: one row per (timestamp, road) even when two writers append the same reading ---
def dedup_readings(stream: DataFrame) -> DataFrame:
    s = event_time(stream).withWatermark("event_ts", WATERMARK)
    return s.dropDuplicatesWithinWatermark(["reading_ts", "road_name"])


def stream_dedup(spark: SparkSession, readings_dirs: list[str], out_dir: str, schema,
                 max_files: int | None = None) -> DataFrame:
    """Files may come in several micro-batches if they come in event-time order, to within the watermark."""
    src = None
    for d in readings_dirs:
        s = _files(spark, d, schema, max_files)
        src = s if src is None else src.unionByName(s)
    q = dedup_readings(src).drop("event_ts").writeStream.format("parquet").option("path", out_dir)
    run_available_now(q, out_dir + "._ckpt")
    return spark.read.parquet(out_dir)


# ---- ST-06: latest reading and band per road (bounded state: one row per road) ----------
def latest_state(stream: DataFrame) -> DataFrame:
    packed = F.struct("reading_ts", "event_id", "a_speed", "a_free_flow", "collection_status")
    g = stream.where(F.col("road_name").isNotNull()).groupBy("road_name").agg(
        F.max_by(packed, F.struct("reading_ts", "event_id")).alias("last"))
    pct = T.congestion_pct("last.a_speed", "last.a_free_flow")
    return g.select("road_name", F.date_format("last.reading_ts", "yyyy-MM-dd HH:mm:ss").alias("reading_time"),
                    F.col("last.a_speed").alias("a_speed"), F.col("last.collection_status").alias("collection_status"),
                    T.congestion_band(pct).alias("band"))


def stream_latest(spark: SparkSession, readings_dir: str, out_dir: str, schema) -> DataFrame:
    def overwrite(batch: DataFrame, epoch_id: int):
        batch.write.mode("overwrite").parquet(out_dir)

    src = spark.readStream.schema(schema).parquet(readings_dir)
    run_available_now(latest_state(src).writeStream.outputMode("complete").foreachBatch(overwrite), out_dir + "._ckpt")
    return spark.read.parquet(out_dir)


# ---- ST-07: score arriving daily rows with a saved model; error per micro-batch ----------
def stream_score(spark: SparkSession, rows_dir: str, out_dir: str, schema, model) -> DataFrame:
    def score(batch: DataFrame, epoch_id: int):
        m = regression_metrics(model.transform(batch), "label", "prediction")
        m.withColumn("batch_id", F.lit(epoch_id)).write.mode("append").parquet(out_dir)

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(rows_dir)
    run_available_now(src.writeStream.foreachBatch(score), out_dir + "._ckpt")
    return spark.read.parquet(out_dir)
