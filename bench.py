"""Time the headline queries: one warm-up on a small table set, then one timed run each; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from millrace.catalog import QUERIES
from millrace.session import local_session

HEADLINE = (
    "daily_net_revenue", "retail_quality_counters", "customer_rfm", "daily_revenue_features", "panel_features", "series_look_back",
    "expanding_mean_encode", "mean_encode_lookup", "null_profile", "impute_with_indicator", "type_profile", "categorical_candidates",
    "leak_pair_sum", "correlation_matrix", "group_stats", "anova_f_statistic", "rank_sums", "hypothesis_report", "document_sections",
    "document_tables", "landing_audit", "histogram", "top_outliers", "ridge_per_series", "forecast_contest", "forecast_revenue",
    "segment_customers", "anomaly_detector",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["daily_revenue_features"].run(spark, sf_dir).count()  # starts the session's threads and code caches
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # A sink that takes every row and column, so that no work is pruned away.
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
