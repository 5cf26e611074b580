"""Partitioned and sized writes, partition evolution, compaction and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import maintenance
from tidemark.operators import snapshots as snap
from tidemark.operators.changes import delete_where
from tidemark.operators.snapshots import read_at
from tidemark.operators.stats import file_stats, gather_stats, partition_stats
from tidemark.operators.writes import append, create_history
from tidemark.plans.files import size_of, work_path
from tidemark.plans.history import History
from tidemark.plans.partitioning import hour_start
from tidemark.sources.sinks import write_partitioned, write_sized as write_at_size
from tidemark.workloads.registry import hour, query, table


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1
""")
def partition_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "events-by-day")
    write_partitioned(table(spark, sf_dir, "events"), path, [("day", "ts")])
    return spark.read.parquet(path).groupBy(F.col("ts_day").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def partition_hour_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "events-by-hour")
    write_partitioned(table(spark, sf_dir, "events"), path, [("hour", "ts"), ("identity", "event_type")])
    return (
        spark.read.parquet(path)
        .groupBy(hour_start(F.col("ts_hour")).alias("hour"), F.col("event_type_identity").alias("event_type"))
        .agg(F.count("*").alias("n"))
    )


@query("SELECT * FROM lineitem")
def write_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "lineitem-sized")
    write_at_size(table(spark, sf_dir, "lineitem"), path, 5_242_880)
    return spark.read.parquet(path)


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS ts_day, count(*) AS record_count, CAST(1 AS BIGINT) AS file_count
FROM events GROUP BY 1
""")
def partition_stats_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = partition_stats(table(spark, sf_dir, "events"), [("day", "ts")])
    return stats.select(F.col("ts_day").cast("string").alias("ts_day"), "record_count", "file_count")


@query("""
SELECT date_trunc('hour', ts) AS ts_hour, count(*) AS record_count, CAST(1 AS BIGINT) AS file_count
FROM events GROUP BY 1
""")
def partition_stats_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_stats(table(spark, sf_dir, "events"), [("hour", "ts")])


def _respecified(spark: SparkSession, sf_dir: str) -> History:
    """events up to mid-month by day, later ones by hour."""
    events = table(spark, sf_dir, "events")
    h = create_history(events.where("ts < timestamp_ntz'2024-01-15'"), work_path(spark, "events"),
                       spec=[("day", "ts")])
    h = maintenance.drop_partition_field(h, "day", "ts")
    h = maintenance.add_partition_field(h, "hour", "ts")
    return append(h, events.where("ts >= timestamp_ntz'2024-01-15'"))


@query("""
SELECT 0 AS spec_id, strftime(ts, '%Y-%m-%d') AS day, CAST(NULL AS TIMESTAMP) AS hour, count(*) AS record_count
FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 2
UNION ALL SELECT 2, NULL, date_trunc('hour', ts), count(*)
FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 3
""")
def partitions_of_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = partition_stats(_respecified(spark, sf_dir))
    return stats.select("spec_id", F.col("ts_day").cast("string").alias("day"), F.col("ts_hour").alias("hour"),
                        "record_count")


@query("SELECT * FROM events")
def partition_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(_respecified(spark, sf_dir))


@query("""
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-13 06:30:00' AND ts < TIMESTAMP '2024-01-16 18:15:00'
""")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.read_range(_respecified(spark, sf_dir), "ts", "2024-01-13 06:30:00", "2024-01-16 18:15:00")


@query("""
SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-05-15'
""")
def range_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of an unpartitioned history in ranges of the column; files whose bounds miss it stay closed."""
    lineitem = table(spark, sf_dir, "lineitem")
    late = lineitem.where("l_shipdate >= timestamp_ntz'1998-01-01' OR l_shipdate IS NULL")
    h = create_history(late, work_path(spark, "lineitem"), properties={"target_file_bytes": str(1 << 20)})
    h = gather_stats(maintenance.cluster_by(h, "l_shipdate"), always=True)
    h = append(h, lineitem.where("l_shipdate < timestamp_ntz'1998-01-01'"))
    return maintenance.read_range(h, "l_shipdate", "1996-03-01", "1996-05-15")


@query("""
SELECT 'c_custkey' AS "column", count(*) AS record_count, CAST(count(*) - count(c_custkey) AS BIGINT) AS null_count,
       CAST(min(c_custkey) AS VARCHAR) AS lower_bound, CAST(max(c_custkey) AS VARCHAR) AS upper_bound
FROM customer WHERE c_nationkey < 20
UNION ALL SELECT 'c_name', count(*), CAST(count(*) - count(c_name) AS BIGINT), min(c_name), max(c_name)
FROM customer WHERE c_nationkey < 20
UNION ALL SELECT 'c_nationkey', count(*), CAST(count(*) - count(c_nationkey) AS BIGINT), CAST(min(c_nationkey) AS VARCHAR),
       CAST(max(c_nationkey) AS VARCHAR) FROM customer WHERE c_nationkey < 20
""")
def file_stats_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts gathered beside the writes, after a delete and a compaction into one file; no data is read for them."""
    customer = table(spark, sf_dir, "customer")
    h = create_history(customer.limit(0), work_path(spark, "customer"), properties={"gather_stats": "true"})
    h = delete_where(append(h, customer.repartition(8)), "c_nationkey >= 20 OR c_nationkey IS NULL")
    h, _ = maintenance.compact(h)
    return file_stats(h, ["c_custkey", "c_name", "c_nationkey"]).select(
        "column", "record_count", "null_count", "lower_bound", "upper_bound")


def _small_files(spark: SparkSession, sf_dir: str) -> History:
    """orders in many small files, one status deleted."""
    orders = table(spark, sf_dir, "orders")
    h = create_history(orders.repartition(20), work_path(spark, "orders"), at=hour(1))
    return delete_where(h, "o_orderstatus = 'P'", at=hour(2))


@query("SELECT * FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
def compact_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _ = maintenance.compact(_small_files(spark, sf_dir), 52_428_800)
    return read_at(h)


@query("""
SELECT CAST(8 AS BIGINT) AS files_before, CAST(8 AS BIGINT) AS files_after, CAST(1 AS BIGINT) AS files_rewritten,
       count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders)
""")
def compact_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files of a size that fits, one row removed from one of them: only that file is written anew."""
    orders = table(spark, sf_dir, "orders")
    h = create_history(orders.repartition(8), work_path(spark, "orders"))
    size = size_of(spark, [h.rows_path(1)])[1]
    h = delete_where(h, F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).scalar())
    h, counts = maintenance.compact(h, size // 8)
    facts = [F.lit(getattr(counts, n)).cast("long").alias(n) for n in ("files_before", "files_after", "files_rewritten")]
    return read_at(h).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).select(*facts, "n", "total")


def _expired(spark: SparkSession, sf_dir: str) -> History:
    """1 load, 2 delete, 3 compact, 4 staged copy of all rows; all but the head of main expire."""
    h = snap.enable_wap(_small_files(spark, sf_dir))
    h, _ = maintenance.compact(h, 52_428_800, at=hour(3))
    h = append(h, table(spark, sf_dir, "orders"), wap_id="unpublished", at=hour(4))
    h, _ = maintenance.expire(h, older_than=hour(5), retain_last=1)
    return h


@query("""
SELECT CAST(3 AS BIGINT) AS snapshot_id, 'replace' AS operation, count(*) AS total_rows
FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'
""")
def expire_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = snap.snapshots(_expired(spark, sf_dir))
    return kept.select("snapshot_id", "operation", F.col("summary")["total_rows"].cast("long").alias("total_rows"))


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' GROUP BY o_orderstatus
""")
def expire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in storage: the deleted and the unpublished rows are gone."""
    return maintenance.stored_rows(_expired(spark, sf_dir)).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
