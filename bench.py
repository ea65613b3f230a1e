"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "page_scores",
    "visible_words",
    "link_resolve",
    "image_dedupe",
    "jsonld_types",
    "issues_title",
    "issues_links",
    "site_score",
    "check_metrics",
    "coverage_totals",
    "top_codes",
    "report_lines",
    "history_topn",
    "previous_audit",
    "diff_summary",
    "bfs_levels",
    "robots_gate",
    "external_worklist",
    "suggest_requests",
    "suggest_parse",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("crawlsight-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="staging-"))  # one machine
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload.queries import QUERIES

    # The given tables are files of one row group, which one task reads. A table of a cluster has many.
    split = tempfile.mkdtemp(prefix="tables-")
    for name in sorted(f[: -len(".parquet")] for f in os.listdir(folder) if f.endswith(".parquet")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if name in ("pages", "documents"):
            rows = rows.repartition(2 * int(cpus))
        rows.write.parquet(f"{split}/{name}.parquet")
    sf, folder = folder.rstrip("/").rsplit("sf", 1)[-1], split

    def run(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    run("page_scores")  # starts the JVM and Python workers
    times = {}
    for name in only:
        start = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )


if __name__ == "__main__":
    main()
