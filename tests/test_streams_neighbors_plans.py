"""Streaming = batch twins, late data, neighbour search vs brute force, payload edges, plan shape."""

import datetime as dt
import json
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from small_data import SF_SMALL
from lanespark.operators import daily as D
from lanespark.operators import neighbors as NB
from lanespark.sources import bindings as B
from lanespark.sources import payloads as P
from lanespark.streaming import jobs as J


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_daily_equals_batch(spark):
    r = B.raw_readings(spark, SF_SMALL)
    path = J.scratch(spark, "t-readings")
    J.land(r, path, partition="reading_date")
    schema = spark.read.parquet(path).schema
    out = J.stream_daily(spark, path, J.scratch(spark, "t-daily"), schema, B.road_dim(spark, SF_SMALL))
    batch = D.daily_rollup(r, B.road_dim(spark, SF_SMALL))
    assert _rows(out.select(*D.DAILY_COLUMNS)) == _rows(batch.select(*D.DAILY_COLUMNS))


def test_stream_ingest_equals_batch_parse(spark):
    docs = P.landed_payloads(B.raw_readings(spark, SF_SMALL))
    landed = J.scratch(spark, "t-landed")
    J.land(docs, landed, fmt="json")
    out = J.stream_ingest(spark, landed, J.scratch(spark, "t-ingest"), docs.schema)
    batch = P.parse_incidents(P.parse_weather(P.parse_jam(P.parse_flow(docs, http_status="http_status"))))
    assert _rows(out.select("event_id", "current_speed", "n_incidents", "weather_main_parsed")) == \
        _rows(batch.select("event_id", "current_speed", "n_incidents", "weather_main_parsed"))


def test_late_rows_dropped_by_window_but_fixed_by_daily_recompute(spark):
    """ST-05: a reading arriving after the watermark is dropped by the 15-minute window job,
    but the date-recomputing daily job still includes it."""
    schema = ("event_id long, reading_ts timestamp_ntz, reading_date date, road_name string, a_speed double, "
              "jam_factor double")
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    base = J.scratch(spark, "t-late")
    early = [(1, t0, t0.date(), "R1", 40.0, 1.0), (2, t0 + dt.timedelta(hours=3), t0.date(), "R1", 42.0, 1.0)]
    late = [(3, t0 + dt.timedelta(minutes=5), t0.date(), "R1", 10.0, 9.0)]
    spark.createDataFrame(early, schema).coalesce(1).write.parquet(base + "/b1")
    src_schema = spark.read.parquet(base + "/b1").schema
    out = base + "/out"
    import shutil, os  # noqa: E401
    os.makedirs(base + "/src")
    q = (J.cycle_stats(spark.readStream.schema(src_schema).parquet(base + "/src"))
         .writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", out + "._ckpt"))
    for f in os.listdir(base + "/b1"):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(base + "/b1", f), os.path.join(base + "/src", "a-" + f))
    h = q.trigger(availableNow=True).start()
    h.awaitTermination()
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(base + "/b2")
    for f in os.listdir(base + "/b2"):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(base + "/b2", f), os.path.join(base + "/src", "b-" + f))
    h = q.trigger(availableNow=True).start()
    h.awaitTermination()
    w = spark.read.parquet(out).where(F.col("cycle") == "2024-01-01 08:00").collect()
    assert len(w) == 1 and w[0]["readings"] == 1            # the late reading was dropped
    all_rows = spark.read.parquet(base + "/src")
    daily = all_rows.groupBy("reading_date", "road_name").agg(F.count(F.lit(1)).alias("n")).collect()
    assert daily[0]["n"] == 3                                # the recompute sees it


def _by_day(spark, readings, folder):
    """One file per reading date, older files first (the file source goes by modification time, then name)."""
    import time
    for (d,) in sorted(tuple(r) for r in readings.select("reading_date").distinct().collect()):
        readings.where(F.col("reading_date") == F.lit(d)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return folder


def test_streams_in_many_micro_batches_equal_one(spark):
    r = B.raw_readings(spark, SF_SMALL)
    some = [x[0] for x in r.select("reading_date").distinct().orderBy("reading_date").limit(5).collect()]
    r = r.where(F.col("reading_date").isin(some))
    src = _by_day(spark, r, J.scratch(spark, "t-days"))
    schema = spark.read.parquet(src).schema
    dim = B.road_dim(spark, SF_SMALL)
    daily = J.stream_daily(spark, src, J.scratch(spark, "t-daily"), schema, dim, max_files=1)
    assert daily.count() == D.daily_rollup(r, dim).count()
    once = J.stream_dedup(spark, [src], J.scratch(spark, "t-dd1"), schema)
    many = J.stream_dedup(spark, [src], J.scratch(spark, "t-dd2"), schema, max_files=1)
    key = ["event_id", "road_name"]
    assert _rows(many.select(*key)) == _rows(once.select(*key))


def test_stream_daily_sees_files_that_arrive_while_it_runs(spark):
    r = B.raw_readings(spark, SF_SMALL)
    day = r.select("reading_date").orderBy("reading_date").first()[0]
    one = r.where(F.col("reading_date") == F.lit(day))
    src, out = J.scratch(spark, "t-grow"), J.scratch(spark, "t-grow-daily")
    one.limit(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    J.stream_daily(spark, src, out, schema, None)
    one.exceptAll(one.limit(1)).write.mode("append").parquet(src)
    assert J.stream_daily(spark, src, out, schema, None).count() == D.daily_rollup(one, None).count()


def test_stream_daily_reads_only_the_dates_it_touches(spark):
    """State files of other dates are no Parquet any more, and stored readings are gone: a late file still counts."""
    import os
    r = B.raw_readings(spark, SF_SMALL)
    days = [x[0] for x in r.select("reading_date").distinct().orderBy("reading_date").limit(3).collect()]
    some = r.where(F.col("reading_date").isin(days))
    late = some.where((F.col("reading_date") == F.lit(days[1])) & (F.col("event_id") % 3 == 0))
    src, out = J.scratch(spark, "t-touch"), J.scratch(spark, "t-touch-daily")
    some.join(late.select("event_id"), "event_id", "left_anti").select(*r.columns).write.parquet(src)
    schema = spark.read.parquet(src).schema
    J.stream_daily(spark, src, out, schema, None)
    spoiled = 0
    for folder, _, files in os.walk(out + "._state"):
        if "traffic_date=" in folder and f"traffic_date={days[1]}" not in folder:
            for f in files:
                with open(os.path.join(folder, f), "wb") as h:
                    h.write(b"no parquet")
                spoiled += 1
    for f in os.listdir(src):
        with open(os.path.join(src, f), "wb") as h:
            h.write(b"")
    assert spoiled
    late.write.mode("append").parquet(src)
    got = J.stream_daily(spark, src, out, schema, None).select(*D.DAILY_COLUMNS)
    assert _rows(got) == _rows(D.daily_rollup(some, None).select(*D.DAILY_COLUMNS))


def test_a_batch_that_runs_again_changes_nothing(spark):
    r = B.raw_readings(spark, SF_SMALL)
    out = J.scratch(spark, "t-again")
    halves = [r.where(F.col("event_id") % 2 == k) for k in (0, 1)]
    for batch_id, half in ((0, halves[0]), (1, halves[1]), (1, halves[1]), (0, halves[0])):
        J.upsert_daily(half, batch_id, out + "._state", out, None)
    J.upsert_daily(r.limit(0), 2, out + "._state", out, None)       # an empty batch
    got = spark.read.parquet(out).select(*D.DAILY_COLUMNS)
    assert _rows(got) == _rows(D.daily_rollup(r, None).select(*D.DAILY_COLUMNS))


def _vectors(spark, rows, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v], None) for i, v in rows],
                                 f"{name} long, v array<double>, grp long")


def _brute(queries, base, k):
    out = {}
    for i, v in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(b)) ** 2).sum())), j) for j, b in base)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("cell_rows,block_rows,query_rows", [(256, 4096, 8192), (20, 15, 30)])
def test_neighbours_are_exact_and_k_each(spark, cell_rows, block_rows, query_rows):
    rng = np.random.default_rng(1)
    base = [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)))] + [(1000 + i, np.ones(8)) for i in range(100)]
    queries = [(i, v) for i, v in enumerate(rng.normal(size=(40, 8)))] + [(99, np.ones(8))]
    got = {}
    for r in NB.nearest(_vectors(spark, queries, "query_id"), _vectors(spark, base, "neighbor_id"), 7, cell_rows,
                        block_rows, query_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbor_id))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == _brute(queries, base, 7)


def test_cells_of_two_levels_are_exact(spark):
    rng = np.random.default_rng(4)
    base = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 3)))]
    queries = [(i, v) for i, v in enumerate(rng.normal(size=(30, 3)))]
    got = {}
    for r in NB.nearest(_vectors(spark, queries, "query_id"), _vectors(spark, base, "neighbor_id"), 4, cell_rows=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.neighbor_id))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == _brute(queries, base, 4)


def test_base_rows_travel_only_to_the_parts_that_ask(spark):
    """Clustered rows: four times as many queries send at most a few more base rows, and never all to all parts."""
    rng = np.random.default_rng(6)
    spots = rng.normal(size=(40, 5)) * 50
    base = _vectors(spark, [(i, spots[i % 40] + rng.normal(size=5)) for i in range(2000)], "neighbor_id")
    cells = NB.Cells(base, 2000, 50, 42)
    copies = []
    for n in (400, 1600):
        q = _vectors(spark, [(i, spots[i % 40] + rng.normal(size=5)) for i in range(n)], "query_id") \
            .withColumn("kth", F.lit(None).cast("double"))
        copies.append(cells.deal(cells.ask(q, 5, True), 4096, 100)[1].count())
    assert copies[1] <= 2 * 2000 and copies[1] <= 2 * copies[0]


def test_a_query_goes_once_to_neighbouring_cells(spark):
    """Vectors without structure: a query that needs all cells is sent once a region, not once a cell."""
    rng = np.random.default_rng(7)
    base = _vectors(spark, list(enumerate(rng.normal(size=(2000, 16)))), "neighbor_id")
    q = _vectors(spark, list(enumerate(rng.normal(size=(50, 16)))), "query_id").withColumn("kth", F.lit(None).cast("double"))
    cells = NB.Cells(base, 2000, 50, 42, region_rows=1000)
    assert len(cells.centers) == 40 and cells.region.max() <= 4
    sent, held = cells.deal(cells.ask(q, 5, False), 1000, 100)
    assert 0 < sent.count() <= 50 * 5
    assert held.count() <= 2000


def test_equal_vectors_take_bounded_memory():
    """Many copies of one vector: the smallest ids win, and no task holds all equal pairs at once."""
    rng = np.random.default_rng(8)
    spot, other = rng.normal(size=(2, 64))
    base = pd.DataFrame({"neighbor_id": np.arange(3000)[::-1], "v": [spot] * 2990 + [other] * 10, "grp": [1.0, 2.0] * 1500})
    asked = pd.DataFrame({"query_id": np.arange(600), "v": [spot] * 600, "grp": [2.0] * 600})
    tracemalloc.start()
    try:
        got = NB._search(5)(None, asked, base)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    smallest = sorted(i for i, g, v in zip(base["neighbor_id"], base["grp"], base["v"]) if g == 1 and v is spot)[:5]
    assert got.groupby("query_id")["neighbor_id"].agg(list).tolist() == [smallest] * 600
    assert peak < 200_000_000


def test_neighbours_of_few_or_no_rows(spark):
    q, none = _vectors(spark, [(1, [0.0, 1.0])], "query_id"), _vectors(spark, [], "neighbor_id")
    assert NB.nearest(q, none, 3).count() == 0
    two = _vectors(spark, [(5, [0.0, 1.0]), (6, [3.0, 1.0])], "neighbor_id")
    assert [(r.neighbor_id, r.distance) for r in NB.nearest(q, two, 3).orderBy("rank").collect()] == [(5, 0.0), (6, 3.0)]


def test_distance_weighted_zero_distance_takes_all_weight(spark):
    neigh = spark.createDataFrame([(1, 10, 0.0), (1, 11, 1.0), (2, 10, 1.0), (2, 11, 3.0)],
                                  "query_id long, neighbor_id long, distance double")
    labels = spark.createDataFrame([(10, 5.0), (11, 9.0)], "vec_id long, label double")
    out = {r[0]: r[1] for r in NB.knn_predict(neigh, labels, "vec_id", "label", "distance").collect()}
    assert out[1] == 5.0
    assert out[2] == pytest.approx((5.0 / 1 + 9.0 / 3) / (1 + 1 / 3))


def test_payload_edges(spark):
    docs = [json.dumps(d) for d in [
        {}, {"results": []}, {"results": [{"currentFlow": {"speed": 10.0, "freeFlow": 20.0, "jamFactor": 3.0}}]}]]
    jam = P.parse_jam(spark.createDataFrame([(d,) for d in docs], "jam_json string")).collect()
    assert [r["jam_status"] for r in jam] == ["no_data", "no_data", "ok"]
    assert jam[2]["jam_speed_kmh"] == 36.0 and jam[2]["traversability"] == "open"
    w = [json.dumps(d) for d in [{"weather": []}, {"rain": {"1h": 0}}, {"rain": {"1h": 1.5}, "weather": [{"main": "Rain"}]}]]
    wr = P.parse_weather(spark.createDataFrame([(d,) for d in w], "weather_json string")).collect()
    assert [r["weather_main_parsed"] for r in wr] == ["Unknown", "Unknown", "Rain"]
    assert [r["rain_mm"] for r in wr] == [0.0, 0.0, 1.5]
    assert wr[0]["weather_description"] == ""
    inc = [json.dumps({"incidents": x}) for x in [
        [], [{"type": "CONSTRUCTION"}], [{"type": "ROAD_WORK"}], [{"type": "ROAD_CLOSURE"}],
        [{"type": "OTHER", "properties": {"iconCategory": 7}}], [{"type": "OTHER", "properties": {"iconCategory": 8}}],
        [{"type": "OTHER", "properties": {"iconCategory": 9}}], [{"type": "OTHER", "properties": {"iconCategory": 1}}]]]
    ir = P.parse_incidents(spark.createDataFrame([(d,) for d in inc], "incidents_json string")).collect()
    assert [r["construction"] for r in ir] == [False, True, True, True, True, True, True, False]
    assert [r["construction_by_type"] for r in ir] == [False, True, True, True, False, False, False, False]
    fl = P.parse_flow(spark.createDataFrame([("{}", 200), ('{"flowSegmentData": {"currentSpeed": 5}}', 500)],
                                            "flow_json string, http_status int"), http_status="http_status").collect()
    assert fl[0]["road_closed"] is False and fl[1]["current_speed"] is None and fl[1]["flow_status"] == "http_500"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_windows_share_one_exchange(spark):
    from lanespark.operators import features as FE
    d = B.daily_traffic(spark, SF_SMALL)
    plan = _plan(FE.rolling_features(FE.lag_features(d)))
    # one exchange for the binding's aggregation + one for the shared road window
    assert plan.count("Exchange hashpartitioning") == 2


def test_filter_date_prunes_partitions(spark):
    r = B.raw_readings(spark, SF_SMALL)
    path = J.scratch(spark, "t-part")
    J.land(r, path, partition="reading_date")
    df = spark.read.parquet(path).where(F.col("reading_date") == "2024-01-15")
    df.explain()
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(reading_date" in plan and "2024-01-15" in plan


def test_road_dimension_join_is_broadcast(spark):
    from lanespark.plans import registry
    registry.load_all()
    plan = _plan(registry.QUERIES["daily_rollup"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_latest_reading_needs_no_sort_of_all_readings(spark):
    from lanespark.operators import monitor as M
    plan = _plan(M.latest_per_road(B.raw_readings(spark, SF_SMALL), ["event_id", "a_speed"]))
    first = plan[plan.rindex("max(reading_ts"):]
    assert "SortAggregate" not in first and "HashAggregate" in plan


def test_raw_readings_are_only_hash_aggregated(spark):
    """Roll-up and cycle weather: what stands on the raw readings is a HashAggregate; sorts see its few rows."""
    from lanespark.plans import registry
    registry.load_all()
    for key in ("daily_rollup", "daily_weather_mode", "daily_area", "join_cycle_weather"):
        plan = _plan(registry.QUERIES[key](spark, SF_SMALL))
        assert "ObjectHashAggregate" not in plan, key
        lines = plan.splitlines()
        indent = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
        for k, line in enumerate(lines):
            if "FileScan" not in line or "event_type" not in line and "ts#" not in line:
                continue
            level, above = indent(line), ""     # the first aggregate above this scan
            for up in reversed(lines[:k]):
                if indent(up) < level:
                    level = indent(up)
                    if "Aggregate" in up or "Join" in up:
                        above = up
                        break
            assert "SortAggregate" not in above, key
