"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chronopanel.plans import all_queries  # noqa: E402
from chronopanel.session import get_session  # noqa: E402

HEADLINE = [
    "flagship_best_model",
    "flagship_many_series",
    "A1_daily_extract",
    "A3_weekly_rollup",
    "A11_describe",
    "A12_quantiles",
    "A19_correlations",
    "J1_covariate_join",
    "S12_reindex",
    "S13_fill_gaps",
    "W1_moving_means",
    "W5_raw_event_gaps",
    "W12_winsorise",
    "D1_classical_additive",
    "D5_stl",
    "D6_x11_filters",
    "X1_acf",
    "X1_acf_many_series",
    "X5_kpss",
    "X12_intermittency",
    "X14_guerrero",
    "M5_basic_fit",
    "M7_multiple_regression",
    "M9_trend_season_covariates",
    "M11_fourier",
    "M15_fixed_ar2",
    "EV3_share_sweep",
    "EV5_expanding_validation",
    "EV6_accuracy",
    "EV13_residual_tests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Untimed: start the executors, the code cache and one Python worker pool.
    for name in ("W1_moving_means", "M13_covariates_only"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
