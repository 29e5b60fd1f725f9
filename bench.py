"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.  Each query is executed completely through the
``noop`` sink (full plan, no result transfer to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.catalog import load_all  # noqa: E402
from tidewatch.session import build_session  # noqa: E402

HEADLINE = [
    # reporting
    "attack_distribution", "protocol_breakdown", "traffic_by_class", "alert_summary",
    "latest_run_per_algorithm", "model_leaderboard", "platform_summary",
    # data quality / profiling
    "null_profile", "duplicate_rows", "column_cardinality", "describe_numeric",
    "percentile_summary", "leakage_scan", "corr_matrix", "ks_two_sample", "boxplot_stats",
    "histogram_dur", "validate_flows",
    # metrics
    "binary_metrics", "class_report", "roc_auc", "average_precision", "best_threshold",
    "mcnemar",
    # features / ingest / models / streams
    "scaler_stats", "csv_flow_ingest", "iforest_scores", "kmeans_anomalies", "login_lockouts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", app="tidewatch-bench",
                          shuffle_partitions=int(cpus))
    q = load_all()
    q["label_split"].build(spark, sf).write.format("noop").mode("overwrite").save()  # JVM warm-up
    times = {}
    for n in names:
        t0 = time.perf_counter()
        q[n].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf_name = os.path.basename(os.path.normpath(sf)).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_name}))


if __name__ == "__main__":
    main()
