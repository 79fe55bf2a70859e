"""Benchmark the headline queries.

Runs every headline query of the registry at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.

Each query is executed fully with the ``noop`` sink (no driver collect), after
one warm-up query so JVM start-up is not charged to the first query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanespark.plans import registry  # noqa: E402
from lanespark.session import get_session  # noqa: E402

# Queries timed by the bench (stages of the reference's flow: roll-up, profiling,
# temporal analysis, monitoring, feature table, split, model, online adaptation).
BENCH_KEYS = [
    "daily_rollup", "daily_banded", "describe_numeric", "correlation_matrix", "missing_profile",
    "monthly_stats", "month_over_month", "day_of_week", "weather_distribution", "area_month_pivot",
    "centered_ma30", "collection_history", "collection_kpis", "road_success_rate", "latest_snapshot",
    "temporal_features", "context_enrich", "train_test_split", "regression_metrics", "best_per_family",
    "utility_score", "ridge", "gradient_boosting", "random_forest", "stacking", "knn", "online_windows",
    "stream_cycle_15m", "stream_daily",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    registry.load_all()
    # warm-up (JIT, class loading) on both input paths: daily table and raw readings
    for key in ("yearly_avg", "hourly_pattern"):
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in BENCH_KEYS:
        t0 = time.perf_counter()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)    # so that a slow query does not hide the others
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
