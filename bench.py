"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, the median counts).
Every run builds its histories anew, so writes are timed with the reads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changes import delete_where
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history
from tidemark.plans.files import work_path
from tidemark.workloads import QUERIES
from tidemark.workloads.registry import table

HEADLINE = [
    "scan_filter_ts", "group_count", "histogram_22", "trim_outliers", "update_ratio", "delete_or_predicate",
    "update_matching", "upsert_result", "time_travel", "wap_publish", "partition_day", "range_read",
    "compact_content", "stream_append", "reconcile", "file_stats",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def read_after(spark: SparkSession, sf_dir: str, commits: int):
    """A history with many commits; what is timed is the read of its head."""
    events = table(spark, sf_dir, "events")
    h = create_history(events, work_path(spark, "bench-events"))
    part = events.where("event_type = 'error'").coalesce(1)
    for i in range(commits - 1):
        if i % 5 == 4:
            h = delete_where(h, (F.col("user_id") == i - 1) & (F.col("value") > 100))
        else:
            h = append(h, part.withColumn("user_id", F.lit(i).cast("long")))
    return lambda: drain(read_at(h).groupBy("event_type").agg(F.count("*"), F.sum("value")))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-bench-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    works = {name: (lambda q=QUERIES[name]: drain(q(spark, sf_dir))) for name in HEADLINE}
    for commits in (10, 100):
        works[f"read_after_{commits}_commits"] = read_after(spark, sf_dir, commits)
    times: dict[str, float] = {}
    for name, work in works.items():
        work()  # warm up
        times[name] = round(statistics.median(timed(work) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
