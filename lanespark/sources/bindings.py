"""Bindings from the given parquet tables to the traffic data model.

The test tables are TPC-H-like; these views re-read them as the traffic
tables the operators work on (see FIXTURES.md §2):

* ``raw_readings``  – one sensor/weather reading per event row
* ``road_dim``      – road dimension (lanes, capacity), some roads missing
* ``daily_traffic`` – historical daily table, one row per (date, road)
* ``model_runs``    – model result rows (family, variant, scores)
* ``predictions``   – actual vs predicted values
* ``feature_scores``– two scores per "feature"

Each binding exists twice with the same meaning: as DataFrame code (what the
Spark queries run) and as DuckDB SQL text (what the independent oracle runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    ff = F.lit(30.0) + (F.col("user_id") % 5) * F.lit(10.0)
    cur = F.when(F.col("event_type") == "error", F.lit(None).cast("double")) \
        .otherwise(F.least(F.col("value"), ff * F.lit(1.2)))
    s = e.withColumn("ff", ff).withColumn("cur", cur)
    k, c = F.col("k"), F.col("cur")
    null_d = F.lit(None).cast("double")
    return s.select(
        "event_id",
        F.col("ts").alias("reading_ts"),
        F.col("ts").cast("date").alias("reading_date"),
        F.hour("ts").cast("int").alias("reading_hour"),
        F.concat(F.lit("Road "), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("road_name"),
        F.concat(F.lit("Area "), (F.col("user_id") % 8).cast("string")).alias("area_name"),
        c.alias("a_speed"),
        F.col("ff").alias("a_free_flow"),
        F.when(c.isNull() | (k < 5), null_d)
         .otherwise(F.lit(7200.0) / F.greatest(c, F.lit(1.0))).alias("a_travel_time"),
        F.when(c.isNull(), null_d).otherwise(F.lit(7200.0) / F.col("ff")).alias("a_free_flow_time"),
        F.when(c.isNull(), null_d).otherwise(k / F.lit(100.0)).alias("confidence"),
        F.when(c.isNull() | (k % 3 == 0), null_d).otherwise(c * F.lit(1.1)).alias("b_speed"),
        F.when(k % 3 == 0, null_d).otherwise(F.col("ff") * F.lit(1.05)).alias("b_free_flow"),
        F.when(k % 10 == 9, null_d).otherwise(k / F.lit(10.0)).alias("jam_factor"),
        F.when(k < 15, F.lit(None).cast("string"))
         .when(k < 55, "Clear").when(k < 70, "Rain").when(k < 80, "Mist")
         .when(k < 95, "Clouds").otherwise("Squall").alias("weather_main"),
        (F.lit(20.0) + k / F.lit(10.0)).alias("temperature_c"),
        (F.lit(40.0) + k / F.lit(2.0)).alias("humidity_pct"),
        (k * F.lit(0.15)).alias("wind_speed_ms"),
        (F.lit(10000.0) - k * F.lit(50.0)).alias("visibility_m"),
        F.when((k >= 55) & (k < 70), k / F.lit(10.0)).otherwise(F.lit(0.0)).alias("rain_1h_mm"),
        F.when(F.col("event_type") == "purchase", k % 4).alias("incident_count"),
        (k % 25 == 0).alias("has_construction"),
        (k % 50 == 7).alias("road_closure"),
        F.when((F.col("event_type") == "error") & (k < 15), "failed")
         .when((F.col("event_type") == "error") | (k < 15), "partial")
         .otherwise("success").alias("collection_status"),
    )


def road_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("user_id") % 10 != 0)
    return ev.select(
        F.concat(F.lit("Road "), F.lpad(F.col("user_id").cast("string"), 5, "0")).alias("road_name"),
        F.when(F.col("user_id") % 2 == 0, 4).otherwise(6).alias("lanes"),
        (F.lit(3500) + (F.col("user_id") % 7) * 500).cast("int").alias("max_capacity_vph"),
    ).distinct()


def _dsum_double(c):
    """Exact sum of DECIMAL(18,2) values, returned as double (partition-order independent).

    Summed as whole cents in a long (fast codegen'd arithmetic instead of
    BigDecimal buffers); ``cents / 100.0`` is the correctly rounded double of
    the exact decimal sum, i.e. the same value as CAST(sum(decimal) AS DOUBLE).
    """
    cents = F.rint(F.col(c).cast("decimal(18,2)").cast("double") * F.lit(100.0)).cast("long")
    return F.sum(cents) / F.lit(100.0)


def daily_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    road_no = F.col("l_suppkey") % 16
    n = F.count(F.lit(1))
    weather_code = F.min("l_orderkey") % 5
    return (
        li.groupBy(
            F.col("l_shipdate").cast("date").alias("traffic_date"),
            F.concat(F.lit("Road "), F.lpad(road_no.cast("string"), 2, "0")).alias("road_name"),
            F.concat(F.lit("Area "), F.floor(road_no / F.lit(2.0)).cast("int").cast("string")).alias("area_name"),
        )
        .agg(
            _dsum_double("l_extendedprice").alias("volume"),
            (_dsum_double("l_quantity") / n).alias("avg_speed"),
            (F.lit(1.0) + F.lit(10.0) * _dsum_double("l_tax") / n).alias("tti"),
            (F.lit(1000.0) * _dsum_double("l_discount") / n).alias("congestion"),
            (F.sum(F.col("l_partkey") % 101).cast("double") / n).alias("capacity_util"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("incidents"),
            F.when(weather_code == 0, "Clear").when(weather_code == 1, "Fog")
             .when(weather_code == 2, "Overcast").when(weather_code == 3, "Rain")
             .otherwise("Windy").alias("weather"),
            F.when(F.min("l_linenumber") == 1, "Yes").otherwise("No").alias("roadwork"),
        )
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = (F.col("p_partkey") * 37 % 1000).cast("double") / F.lit(1000.0) - F.lit(0.05)
    return p.select(
        F.col("p_brand").alias("model"),
        F.concat(F.lit("v="), F.col("p_partkey").cast("string")).alias("variant"),
        base.alias("test_r2"),
        (base + (F.col("p_size") % 15 - 4) / F.lit(50.0)).alias("train_r2"),
        F.col("p_retailprice").alias("test_rmse"),
        (F.col("p_size").cast("double") / F.lit(10.0)).alias("train_time"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_extendedprice").alias("actual"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("predicted"),
    )


def feature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")) \
        .agg(_dsum_double("c_acctbal").alias("cs"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")) \
        .agg(_dsum_double("s_acctbal").alias("ss"))
    return (
        nation.join(c, nation.n_nationkey == c.k, "left")
        .join(s, nation.n_nationkey == s.k, "left")
        .select(F.col("n_name").alias("feature"),
                F.coalesce("cs", F.lit(0.0)).alias("mi_score"),
                F.coalesce("ss", F.lit(0.0)).alias("rf_importance"))
    )


BINDINGS = {
    "raw_readings": raw_readings,
    "road_dim": road_dim,
    "daily_traffic": daily_traffic,
    "model_runs": model_runs,
    "predictions": predictions,
    "feature_scores": feature_scores,
}


# ---------------------------------------------------------------------------
# The same bindings as DuckDB SQL, used as CTEs in the oracle queries.
# ---------------------------------------------------------------------------
ORACLE_CTE = {
    "raw_readings": """
raw_readings AS (
  WITH e AS (SELECT event_id, ts, user_id, event_type, value,
                    CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
       s AS (SELECT *, 30.0e0 + (user_id % 5) * 10.0e0 AS ff,
                    CASE WHEN event_type = 'error' THEN NULL
                         ELSE least(value, (30.0e0 + (user_id % 5) * 10.0e0) * 1.2e0) END AS cur FROM e)
  SELECT event_id, ts AS reading_ts, CAST(ts AS DATE) AS reading_date,
         CAST(hour(ts) AS INT) AS reading_hour,
         concat('Road ', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS road_name,
         concat('Area ', CAST(user_id % 8 AS VARCHAR)) AS area_name,
         cur AS a_speed, ff AS a_free_flow,
         CASE WHEN cur IS NULL OR k < 5 THEN NULL ELSE 7200.0e0 / greatest(cur, 1.0e0) END AS a_travel_time,
         CASE WHEN cur IS NULL THEN NULL ELSE 7200.0e0 / ff END AS a_free_flow_time,
         CASE WHEN cur IS NULL THEN NULL ELSE k / 100.0e0 END AS confidence,
         CASE WHEN cur IS NULL OR k % 3 = 0 THEN NULL ELSE cur * 1.1e0 END AS b_speed,
         CASE WHEN k % 3 = 0 THEN NULL ELSE ff * 1.05e0 END AS b_free_flow,
         CASE WHEN k % 10 = 9 THEN NULL ELSE k / 10.0e0 END AS jam_factor,
         CASE WHEN k < 15 THEN NULL WHEN k < 55 THEN 'Clear' WHEN k < 70 THEN 'Rain' WHEN k < 80 THEN 'Mist'
              WHEN k < 95 THEN 'Clouds' ELSE 'Squall' END AS weather_main,
         20.0e0 + k / 10.0e0 AS temperature_c, 40.0e0 + k / 2.0e0 AS humidity_pct, k * 0.15e0 AS wind_speed_ms,
         10000.0e0 - k * 50.0e0 AS visibility_m,
         CASE WHEN k >= 55 AND k < 70 THEN k / 10.0e0 ELSE 0.0e0 END AS rain_1h_mm,
         CASE WHEN event_type = 'purchase' THEN k % 4 ELSE NULL END AS incident_count,
         (k % 25 = 0) AS has_construction, (k % 50 = 7) AS road_closure,
         CASE WHEN event_type = 'error' AND k < 15 THEN 'failed'
              WHEN event_type = 'error' OR k < 15 THEN 'partial' ELSE 'success' END AS collection_status
  FROM s)""",
    "road_dim": """
road_dim AS (
  SELECT DISTINCT concat('Road ', lpad(CAST(user_id AS VARCHAR), 5, '0')) AS road_name,
         CASE WHEN user_id % 2 = 0 THEN 4 ELSE 6 END AS lanes,
         CAST(3500 + (user_id % 7) * 500 AS INT) AS max_capacity_vph
  FROM events WHERE user_id % 10 <> 0)""",
    "daily_traffic": """
daily_traffic AS (
  SELECT CAST(l_shipdate AS DATE) AS traffic_date,
         concat('Road ', lpad(CAST(l_suppkey % 16 AS VARCHAR), 2, '0')) AS road_name,
         concat('Area ', CAST(CAST(floor((l_suppkey % 16) / 2.0e0) AS INT) AS VARCHAR)) AS area_name,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS volume,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_speed,
         1.0e0 + 10.0e0 * CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS tti,
         1000.0e0 * CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS congestion,
         CAST(sum(l_partkey % 101) AS DOUBLE) / count(*) AS capacity_util,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INT) AS incidents,
         CASE min(l_orderkey) % 5 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Fog' WHEN 2 THEN 'Overcast'
              WHEN 3 THEN 'Rain' ELSE 'Windy' END AS weather,
         CASE WHEN min(l_linenumber) = 1 THEN 'Yes' ELSE 'No' END AS roadwork
  FROM lineitem GROUP BY 1, 2, 3)""",
    "model_runs": """
model_runs AS (
  SELECT p_brand AS model, concat('v=', CAST(p_partkey AS VARCHAR)) AS variant,
         (CAST(p_partkey * 37 % 1000 AS DOUBLE)) / 1000.0e0 - 0.05e0 AS test_r2,
         (CAST(p_partkey * 37 % 1000 AS DOUBLE)) / 1000.0e0 - 0.05e0 + (p_size % 15 - 4) / 50.0e0 AS train_r2,
         p_retailprice AS test_rmse, CAST(p_size AS DOUBLE) / 10.0e0 AS train_time
  FROM part)""",
    "predictions": """
predictions AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS actual,
         l_quantity * p_retailprice AS predicted
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "feature_scores": """
feature_scores AS (
  SELECT n_name AS feature, coalesce(c.s, 0.0e0) AS mi_score, coalesce(s.s, 0.0e0) AS rf_importance
  FROM nation
  LEFT JOIN (SELECT c_nationkey AS k, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS s
             FROM customer GROUP BY 1) c ON c.k = n_nationkey
  LEFT JOIN (SELECT s_nationkey AS k, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS s
             FROM supplier GROUP BY 1) s ON s.k = n_nationkey)""",
}


def with_bindings(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix an oracle query with the binding CTEs it uses (and extra CTEs after them)."""
    parts = [ORACLE_CTE[n].strip() for n in names]
    for k, body in (extra or {}).items():
        parts.append(f"{k} AS (\n{body.strip()}\n)")
    if not parts:
        return sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def version(spark, sf_dir: str, name: str) -> tuple:
    """What identifies a table's files as they are now: their number, newest change and names."""
    f = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_modification_time",
                                          "_metadata.file_size").distinct()
    return tuple(f.agg(F.count("*"), F.max("file_modification_time").cast("string"), F.sum("file_size"),
                       F.bit_xor(F.xxhash64("file_path"))).first())
