"""Sources and sinks with explicit schemas (SRC-01..04, SNK-01..07).

Paths are caller-chosen (on a cluster: the shared storage). Writes are
partitioned by date where the data is time-keyed, so readers prune partitions
and the daily upsert can overwrite just the dates it touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values that must equal the reference's ---------------------------
REQUIRED_DAILY = ["Area Name", "Road/Intersection Name", "Date", "Traffic Volume", "Average Speed",
                  "Travel Time Index", "Congestion Level", "Road Capacity Utilization", "Incident Reports",
                  "Weather Conditions", "Roadwork and Construction Activity"]
# Historical CSV header -> our column names.
DAILY_CSV_NAMES = {"Date": "traffic_date", "Area Name": "area_name", "Road/Intersection Name": "road_name",
                   "Traffic Volume": "volume", "Average Speed": "avg_speed", "Travel Time Index": "tti",
                   "Congestion Level": "congestion", "Road Capacity Utilization": "capacity_util",
                   "Incident Reports": "incidents", "Weather Conditions": "weather",
                   "Roadwork and Construction Activity": "roadwork",
                   "Environmental Impact": "environmental_impact", "Public Transport Usage": "public_transport_usage",
                   "Traffic Signal Compliance": "traffic_signal_compliance", "Parking Usage": "parking_usage",
                   "Pedestrian and Cyclist Count": "pedestrian_cyclist_count"}
# -----------------------------------------------------------------------------

DAILY_CSV_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()), T.StructField("Area Name", T.StringType()),
    T.StructField("Road/Intersection Name", T.StringType()), T.StructField("Traffic Volume", T.DoubleType()),
    T.StructField("Average Speed", T.DoubleType()), T.StructField("Travel Time Index", T.DoubleType()),
    T.StructField("Congestion Level", T.DoubleType()), T.StructField("Road Capacity Utilization", T.DoubleType()),
    T.StructField("Incident Reports", T.IntegerType()), T.StructField("Environmental Impact", T.DoubleType()),
    T.StructField("Public Transport Usage", T.DoubleType()), T.StructField("Traffic Signal Compliance", T.DoubleType()),
    T.StructField("Parking Usage", T.DoubleType()), T.StructField("Pedestrian and Cyclist Count", T.IntegerType()),
    T.StructField("Weather Conditions", T.StringType()),
    T.StructField("Roadwork and Construction Activity", T.StringType()),
])


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required: list[str] = REQUIRED_DAILY) -> DataFrame:
    """SRC-02: fail before any action when a required column is missing (lists all of them)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"Missing required columns: {missing}")
    return df


def scan_daily_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: historical CSV with an explicit schema (no inference pass over the data)."""
    df = spark.read.schema(DAILY_CSV_SCHEMA).option("header", True).csv(path)
    require_columns(df)
    return df.withColumnsRenamed({k: v for k, v in DAILY_CSV_NAMES.items() if k in df.columns})


def scan_raw(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC-03: raw readings; an absent or empty location gives an empty frame."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_raw(df: DataFrame, path: str) -> None:
    """SNK-01: append one collection cycle, partitioned by date."""
    df.write.mode("append").partitionBy("reading_date").parquet(path)


def write_daily(df: DataFrame, path: str) -> None:
    """SNK-02 physical form: dynamic partition overwrite replaces only the batch's dates."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("traffic_date").parquet(path))


def write_processed(df: DataFrame, path: str) -> None:
    """SNK-03: cleaned / split data as parquet (row_id and is_test kept as columns)."""
    df.write.mode("overwrite").parquet(path)


def scan_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-04: the saved split read back as (train, test)."""
    df = spark.read.parquet(path)
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


def metadata_frame(df: DataFrame, features: list[str], target: str, encoded: list[str]) -> DataFrame:
    """SNK-04: one-row metadata (feature list, sizes, date range, encoder maps) as a DataFrame.

    The maps (alphabetical code of each value of the ``encoded`` columns) are built inside Spark."""
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min("traffic_date").alias("first_date"),
                   F.max("traffic_date").alias("last_date"))
    for c in encoded:
        values = df.agg(F.array_sort(F.collect_set(c)).alias("v"))  # a set of one column's categories
        stats = stats.crossJoin(values.select(F.map_from_entries(F.transform(
            "v", lambda x, i: F.struct(x, i))).alias(f"_map_{c}")))
    maps = F.create_map(*[x for c in encoded for x in (F.lit(c), F.col(f"_map_{c}"))])
    return stats.select(F.array(*[F.lit(f) for f in features]).alias("features"), F.lit(target).alias("target"),
                        "n_rows", F.concat_ws(" to ", F.col("first_date").cast("string"),
                                              F.col("last_date").cast("string")).alias("date_range"),
                        maps.alias("encoders"))


def write_metadata(meta: DataFrame, path: str) -> None:
    meta.coalesce(1).write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """SNK-05: result tables as CSV with a header (one file per task)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_filtered(df: DataFrame, path: str) -> None:
    """SNK-06: renamed, filtered rows as CSV."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_findings(df: DataFrame, path: str, col: str = "line") -> None:
    """SNK-07: findings rows as text lines."""
    df.select(col).coalesce(1).write.mode("overwrite").text(path)
