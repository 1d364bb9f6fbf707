"""Time the headline queries and print one JSON line.

Each query runs once to warm up and twice for the clock; the faster run counts. Fits run once. Time covers
building the plan and collecting the whole result.
"""

from __future__ import annotations

import json
import os
import time

from gridtide.queries import QUERIES
from gridtide.session import local_session, release

HEADLINE = (
    "anomaly_log", "anomaly_severity", "anomaly_log_by_series", "resample_hourly", "resample_hourly_by_series",
    "describe_numeric", "summary_minute", "dq_report", "fill_missing", "fill_missing_by_series", "clean_hourly",
    "feat_lags", "feat_rolling_by_series", "feature_table", "split_cv_folds", "consumption_overview", "load_heatmap",
    "power_histogram", "power_kde", "seasonal_decompose", "acf", "feature_correlation", "forecast_blend",
    "evaluate_models", "evaluate_by_series",
)
FITS = ("sarima_hr_fit", "sequence_forecast", "train_and_compare")  # one run each


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf).collect()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs[1:]), 3)
    for name in FITS:
        start = time.perf_counter()
        QUERIES[name](spark, sf).collect()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
