"""Seconds of the headline queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one warm-up, median of three; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from gristmill.plans import registry

HEADLINE = [
    "o090_usage_by_day", "o196_cost_report", "o140_bm25_top", "o141_nearest", "o142_hybrid_search", "o063_snapshot_changes", "o129_line_windows",
    "o220_chunks", "o107_change_risk", "o098_top_identifiers", "o123_representatives", "o067_pull_statuses", "o250_debounce", "o256_counter_rates", "o190_widened_questions",
    "o223_diff_lines", "o225_static_evidence", "o146_relevant_chunks", "o072_history", "o234_compact_context", "o194_usage_records", "o070_import_dependants", "o257_average_durations",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(4):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
