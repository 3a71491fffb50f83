"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_QUERIES  comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

HEADLINE = [
    "diff_counts",
    "column_summary",
    "diff_rows",
    "diff_cells",
    "only_a",
    "outer_status",
    "pair_summary",
    "diff_counts_dup",
    "diff_rows_dup",
    "diff_rows_top_dup",
    "outer_status_dup",
    "diff_counts_hot",
    "diff_groups_hot",
    "positional_summary",
    "key_uniqueness",
    "detect_key_lineitem",
    "detect_key_dup",
    "infer_types_dates",
    "column_structure",
    "clean_documents",
    "match_files_full",
    "sep_detect",
    "bad_lines",
    "scan_delimited",
    "batch_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session and of the code generator is not part of any query.
    QUERIES["diff_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
