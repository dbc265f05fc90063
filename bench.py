"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of task slots. Each query is
run once to warm up and then timed; the result is read in full, as a sink would.
"""

from __future__ import annotations

import json
import os
import time

from plantlytics.plans.queries import QUERIES
from plantlytics.session import get_spark

HEADLINE = (
    "state_efficiency", "state_shares", "status_timeline", "status_runs", "status_runs_hot_instant", "state_blocks",
    "block_points", "date_range_filter", "range_filter", "clamped_range_filter", "text_search_literal",
    "text_search_regex", "preview_topk", "filter_pipeline", "onoff_stats", "onoff_stats_by_kpi", "onoff_delta_by_kpi",
    "describe_profile", "box_summary", "box_outliers", "binary_signal_profile", "kde_counts", "kde_counts_by_kpi",
    "histogram_counts", "bucket_ohlc", "bucket_ohlc_adaptive", "typed_projection", "series_split", "plant_log_scan",
    "csv_roundtrip", "report_tables",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    seconds = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
