"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_RUNS (timed runs per query, default 3), BENCH_QUERIES (comma list).

Each query is executed fully with the ``noop`` sink (no driver collect);
the reported time is the median of the warm runs after one warm-up run.
"""

from __future__ import annotations

import gc
import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from panelcast.plans import catalog  # noqa: E402
from panelcast.session import get_session  # noqa: E402

HEADLINE = (
    "monthly_price_bars", "monthly_indicator_mean", "first_per_month", "align_inner",
    "align_asof", "forward_fill", "feature_table", "feature_table_backfilled",
    "backtest_signals", "metrics_summary", "horizon_grid",
    "experiment_suite", "ks_drift_test", "ks_drift_flag", "adf_test", "multi_linear_forecast",
    "correlation_matrix", "wide_pivot", "cv_ols_r2", "streaming_monthly_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else list(HEADLINE)
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    # process-wide warm-up (JVM JIT, Python workers) so the first query is
    # not timed on a cold JVM
    for _ in range(2):
        catalog.QUERIES["feature_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    spread: dict[str, list[float]] = {}
    for name in names:
        # drop dead DataFrame handles, then let the JVM collect so Spark's
        # context cleaner frees their shuffle files and broadcast blocks
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        fn = catalog.QUERIES[name]
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 4)
        spread[name] = [round(min(samples), 4), round(max(samples), 4)]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "spread": spread, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
