"""Print the SURVEY §2 inventory -> query key table (with check type) as markdown."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lanespark.plans import registry  # noqa: E402

# SURVEY id -> registered query key(s); "test:" = covered by a pytest parity/property test only
INVENTORY = {
    "SRC-01": ["scan_daily", "scan_daily_csv"], "SRC-02": ["require_columns"], "SRC-03": ["scan_raw"], "SRC-04": ["write_processed"],
    "SRC-05": ["parse_flow"], "SRC-06": ["parse_jam"], "SRC-07": ["parse_weather"], "SRC-08": ["parse_incidents"],
    "SRC-09": ["incident_bbox"], "SRC-10": ["road_dim"],
    "SNK-01": ["append_raw"], "SNK-02": ["replace_dates"], "SNK-03": ["write_processed"], "SNK-04": ["write_metadata"],
    "SNK-05": ["write_results"], "SNK-06": ["export_filtered"], "SNK-07": ["findings_table"],
    "PRJ-01": ["clean_numeric"], "PRJ-02": ["parse_date"], "PRJ-03": ["calendar_features"], "PRJ-04": ["day_name"],
    "PRJ-05": ["is_weekend"], "PRJ-06": ["cyclical_encoding"], "PRJ-07": ["days_since_start"],
    "PRJ-08": ["year_progress"], "PRJ-09": ["year_month"], "PRJ-10": ["roadwork_flag"],
    "PRJ-11": ["context_features"], "PRJ-12": ["cross_features"], "PRJ-13": ["jam_factor"],
    "PRJ-14": ["collection_status"], "PRJ-15": ["traversability"], "PRJ-16": ["congestion_band"],
    "PRJ-17": ["threshold_bands", "road_speed", "road_success_rate", "r2_band", "map_live"],
    "PRJ-18": ["overfit_status"], "PRJ-19": ["corr_strength"], "PRJ-20": ["estimate_volume"],
    "PRJ-21": ["map_weather"], "PRJ-22": ["rename_display"], "PRJ-23": ["feature_columns"],
    "PRJ-24": ["drop_incomplete"], "PRJ-25": ["variant_labels"], "PRJ-26": ["fluctuation_reasons"],
    "PRJ-27": ["numeric_columns"], "PRJ-28": ["live_table"], "PRJ-29": ["season_findings"],
    "PRJ-30": ["incident_sampling"],
    "FLT-01": ["filter_date"], "FLT-02": ["facet_filter"], "FLT-03": ["successful_only"],
    "FLT-04": ["significant_change"], "FLT-05": ["having_min_count", "weather_speed"],
    "FLT-06": ["multi_row_groups"], "FLT-07": ["positive_target"], "FLT-08": ["weekday_weekend_split"],
    "JN-01": ["join_road_dim"], "JN-02": ["join_cycle_weather"], "JN-03": ["merge_rankings"],
    "JN-04": ["anti_replaced_dates"], "JN-05": ["semi_selected"], "JN-06": ["align_by_row"], "JN-07": ["map_live"],
    "JN-08": ["broadcast_scalar", "days_since_start"], "JN-09": ["knn_candidates"],
    "AG-01a": ["daily_speed"], "AG-01b": ["daily_tti"], "AG-01c": ["daily_congestion"], "AG-01d": ["daily_capacity"],
    "AG-01e": ["daily_volume"], "AG-01f": ["daily_incidents"], "AG-01g": ["daily_weather_means"],
    "AG-01h": ["daily_weather_mode"], "AG-01i": ["daily_roadwork"], "AG-01j": ["daily_sensor"],
    "AG-01k": ["daily_area"], "AG-01": ["daily_rollup", "daily_banded"],
    "AG-02": ["monthly_stats"], "AG-03": ["month_by_year"], "AG-04": ["yearly_avg"], "AG-05": ["day_of_week"],
    "AG-06": ["weekday_weekend_gap"], "AG-07": ["quarterly"], "AG-08": ["area_stats"], "AG-09": ["weather_stats"],
    "AG-10": ["weather_distribution"], "AG-11": ["area_month_pivot"], "AG-12": ["daily_mean"],
    "AG-13": ["roadwork_impact"], "AG-14": ["describe_numeric"], "AG-15": ["missing_profile"],
    "AG-16": ["value_counts"], "AG-17": ["distinct_counts", "distinct_values"], "AG-18": ["correlation_matrix"],
    "AG-19": ["target_correlation"], "AG-20": ["histogram"], "AG-21": ["iqr_outliers"], "AG-22": ["ecdf"],
    "AG-23": ["collection_history"], "AG-24": ["speed_timeline"], "AG-25": ["road_speed"], "AG-26": ["area_jam"],
    "AG-27": ["hourly_pattern"], "AG-28": ["weather_speed"], "AG-29": ["records_per_day", "records_per_day_summary"],
    "AG-30": ["road_success_rate"], "AG-31": ["collection_kpis"], "AG-32": ["live_kpis"], "AG-33": ["completeness"],
    "AG-34": ["status_distribution"], "AG-35": ["daily_column_stats"],
    "AG-36": ["regression_metrics", "regression_metrics_by_line"], "AG-37": ["residual_stats", "residual_histogram"],
    "AG-38": ["split_means"], "AG-39": ["best_per_family"], "AG-40": ["global_best"], "AG-41": ["date_range"],
    "AG-42": ["window_summary"],
    "WN-01": ["lag_features"], "WN-02": ["rolling_mean", "rolling_mean_safe"], "WN-03": ["rolling_std"],
    "WN-04": ["trend_3"], "WN-05": ["month_over_month"], "WN-06": ["centered_ma30"], "WN-07": ["variant_sensitivity"],
    "WN-08": ["rank_by_score"], "WN-09": ["label_encode"], "WN-10": ["first_seen_encode"],
    "WN-11": ["latest_snapshot", "newest_snapshot"], "WN-12": ["running_success"], "WN-13": ["row_windows"],
    "WN-14": ["expanding_prefix"], "WN-15": ["contiguous_folds"],
    "SL-01": ["sort_daily"], "SL-02": ["sort_series"], "SL-03": ["topk_models"], "SL-04": ["topk_areas"],
    "SL-05": ["topk_features"], "SL-06": ["preview"], "SL-07": ["sample_n"], "SL-08": ["topk_per_group"],
    "SO-01": ["union_daily"], "SO-02": ["pool_providers"], "SO-03": ["expand_training"], "SO-04": ["except_dates"],
    "ST-01": ["stream_ingest"], "ST-02": ["stream_cycle_15m"], "ST-03": ["stream_daily"], "ST-04": ["stream_dedup"],
    "ST-05": ["stream_late"], "ST-06": ["stream_latest"],
    "ST-07": ["stream_score"],
    "FP-01": ["one_hot_weather"], "FP-02": ["train_test_split"], "FP-03": ["standardize"],
    "FP-04": ["temporal_features"], "FP-05": ["context_enrich"], "FP-06": ["prepare_features"],
    "FP-07": ["f_test_topk"], "FP-08": ["mutual_information", "mutual_information_knn"], "FP-09": ["rf_importance"],
    "FP-10": ["adaptive_selection", "feature_selection"], "FP-11": ["lasso_eliminated"], "FP-12": ["coefficient_table"],
    "FP-13": ["importance_share"],
    "ML-01": ["linear_regression"], "ML-02": ["ridge", "ridge_safe"], "ML-03": ["lasso"], "ML-04": ["elastic_net"],
    "ML-05": ["knn", "knn_regression"], "ML-06": ["decision_tree"], "ML-07": ["random_forest"], "ML-08": ["extra_trees"],
    "ML-09": ["gradient_boosting"], "ML-10": ["boosting_curve"], "ML-11": ["evaluate_variant"],
    "ML-12": ["cross_validate"], "ML-13": ["validation_curve", "depth_curve"], "ML-14": ["elbow_k"],
    "ML-15": ["selected_feature_models"], "EN-01": ["stacking"], "EN-02": ["weighted_ensemble", "ensemble_weights"],
    "EN-03": ["pick_best"], "EN-04": ["run_framework"], "ON-01": ["static_windows"], "ON-02": ["online_windows"],
    "ON-03": ["adaptation_gain"], "CM-01": ["improvements"], "CM-02": ["utility_score"], "CM-03": ["model_ranking"],
    "CM-04": ["before_after"], "CM-05": ["overfit_report"], "CM-06": ["multi_horizon"],
}


def main():
    registry.load_all()
    here = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tests")
    tests = "".join(open(os.path.join(here, f)).read() for f in sorted(os.listdir(here)) if f.endswith(".py"))
    lines = ["| SURVEY id | query key(s) | check |", "|---|---|---|"]
    missing = []
    for sid, keys in INVENTORY.items():
        kinds = []
        for k in keys:
            if k.startswith("test:"):
                kinds.append("pytest")
                continue
            if k not in registry.QUERIES:
                missing.append(k)
            kinds.append("SQL oracle" if k in registry.ORACLES else "pytest" if f'"{k}"' in tests else "rows")
        lines.append(f"| {sid} | {', '.join('`' + k.replace('test:', '') + '`' for k in keys)} | {', '.join(sorted(set(kinds)))} |")
    print("\n".join(lines))
    if missing:
        print("MISSING:", missing, file=sys.stderr)
        sys.exit(1)


if __name__ == "__main__":
    main()
