"""Loading, appending and changing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import ieee_divide
from tidemark.operators.changes import UpsertCounts, delete_partition as drop_partition, delete_where, update_where, upsert
from tidemark.operators.evolve import add_column, rename_column
from tidemark.operators.snapshots import cherrypick, create_branch, enable_wap, read_at, staged_snapshot_id
from tidemark.operators.writes import (
    add_derived, append, append_files as append_written, create_history, insert_positional, overwrite,
)
from tidemark.plans.files import work_path
from tidemark.plans.history import History
from tidemark.workloads.registry import history_of, query, table

EARLY = "l_shipdate < timestamp_ntz'1995-01-01'"
LATE = "l_shipdate >= timestamp_ntz'1995-01-01'"


@query("SELECT * FROM orders")
def create_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(history_of(spark, sf_dir, "orders"))


@query("SELECT * FROM lineitem")
def append_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    h = create_history(lineitem.where(EARLY), work_path(spark, "lineitem"))
    late = lineitem.where(LATE)
    return read_at(append(h, late.select(*reversed(late.columns))))


@query("""
SELECT vendor, pickup, distance, fare FROM (
  SELECT l_suppkey AS vendor, l_shipdate AS pickup, l_quantity AS distance, l_extendedprice AS fare FROM lineitem
)
""")
def insert_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    columns = ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    trips = lineitem.where(EARLY).select(*columns).toDF("vendor", "pickup", "distance", "fare")
    h = create_history(trips, work_path(spark, "trips"))
    return read_at(insert_positional(h, lineitem.where(LATE).select(*columns)))


@query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal * 2 AS c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0
""")
def overwrite_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of(spark, sf_dir, "customer")
    rows = read_at(h).where("c_acctbal >= 0").withColumn("c_acctbal", F.col("c_acctbal") * 2)
    return read_at(overwrite(h, rows))


@query("""
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) GROUP BY o_orderstatus
""")
def append_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = append_written(history_of(spark, sf_dir, "orders"), f"{sf_dir}/orders.parquet")
    return read_at(h).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def with_ratio(spark: SparkSession, sf_dir: str) -> History:
    """lineitem with fare and distance renamed, and fare / distance filled in for every row."""
    h = history_of(spark, sf_dir, "lineitem")
    h = rename_column(h, "l_extendedprice", "fare")
    h = rename_column(h, "l_discount", "distance")
    h = add_column(h, "fare_per_distance_unit", "float", after="distance")
    return update_where(h, {"fare_per_distance_unit": "try_divide(fare, distance)"})


_RATIO = "CAST(l_extendedprice / nullif(l_discount, 0) AS FLOAT)"
_RATIO_ROWS = f"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice AS fare, l_discount AS distance,
       {_RATIO} AS fare_per_distance_unit FROM lineitem
"""
_RATIO_COLUMNS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "fare", "distance", "fare_per_distance_unit"]


@query(_RATIO_ROWS)
def update_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(with_ratio(spark, sf_dir)).select(*_RATIO_COLUMNS)


@query(f"SELECT * FROM ({_RATIO_ROWS}) WHERE NOT coalesce(fare_per_distance_unit > 400000.0 OR distance > 0.08, false)")
def delete_or_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = delete_where(with_ratio(spark, sf_dir), "fare_per_distance_unit > 400000.0 OR distance > 0.08")
    return read_at(h).select(*_RATIO_COLUMNS)


@query(f"SELECT * FROM ({_RATIO_ROWS}) WHERE fare_per_distance_unit IS NOT NULL")
def delete_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = delete_where(with_ratio(spark, sf_dir), "fare_per_distance_unit IS NULL")
    return read_at(h).select(*_RATIO_COLUMNS)


@query("SELECT * FROM events WHERE NOT coalesce(event_type = 'error', false)")
def delete_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(delete_where(history_of(spark, sf_dir, "events"), F.col("event_type") == "error"))


@query("""
SELECT 'main' AS branch, count(*) AS n FROM events
UNION ALL SELECT 'new_job', count(*) FROM events WHERE NOT coalesce(event_type LIKE '%', false)
""")
def delete_like_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = create_branch(history_of(spark, sf_dir, "events"), "new_job")
    h = delete_where(h, "event_type LIKE '%'", branch="new_job")
    counts = [
        read_at(h, branch=b).agg(F.lit(b).alias("branch"), F.count("*").alias("n")) for b in ("main", "new_job")
    ]
    return counts[0].union(counts[1])


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders
""")
def update_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = update_where(history_of(spark, sf_dir, "orders"),
                     {"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1},
                     F.col("o_orderpriority") == "1-URGENT")
    return read_at(h)


def _upserted(spark: SparkSession, sf_dir: str) -> tuple[History, UpsertCounts]:
    """All customers come in again, one segment with a changed balance, and every supplier as a new one."""
    h = history_of(spark, sf_dir, "customer", key=["c_custkey"])
    again = table(spark, sf_dir, "customer").withColumn(
        "c_acctbal",
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal")),
    )
    new = table(spark, sf_dir, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    return upsert(h, again.union(new))


@query("""
SELECT c_custkey, c_name, c_nationkey,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM customer
UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier
""")
def upsert_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(_upserted(spark, sf_dir)[0])


@query("""
SELECT (SELECT count(*) FROM supplier) AS inserted,
       (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL) AS updated,
       (SELECT count(*) FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING' AND c_acctbal IS NOT NULL, false))
         AS unchanged
""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _upserted(spark, sf_dir)[1]
    return spark.createDataFrame([(c.inserted, c.updated, c.unchanged)], "inserted long, updated long, unchanged long")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax,
       CASE WHEN tip_per_mile IS NULL THEN 'null' WHEN l_discount <> 0 THEN 'finite'
            WHEN l_tax = 0 THEN 'nan' ELSE 'inf' END AS kind,
       CASE WHEN l_discount <> 0 THEN tip_per_mile END AS tip_per_mile
FROM (SELECT *, CASE WHEN l_tax IS NULL OR l_discount IS NULL THEN NULL
                     WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END AS tip_per_mile FROM lineitem)
""")
def tip_per_mile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of(spark, sf_dir, "lineitem")
    h = add_derived(h, "tip_per_mile", ieee_divide(F.col("l_tax"), F.col("l_discount")))
    tip = F.col("tip_per_mile")
    finite = F.abs(tip) < float("inf")
    kind = F.when(tip.isNull(), "null").when(F.isnan(tip), "nan").when(finite, "finite").otherwise("inf")
    return read_at(h).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", kind.alias("kind"),
        F.when(finite, tip).alias("tip_per_mile"),
    )


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)
UNION ALL SELECT -o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > 100000 AND NOT coalesce(o_orderstatus = 'F', false)
""")
def append_with_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts come from the commits, not from what a user notes in a summary."""
    orders = table(spark, sf_dir, "orders")
    more = orders.where("o_totalprice > 100000").withColumn("o_orderkey", -F.col("o_orderkey"))
    h = append(history_of(spark, sf_dir, "orders"), more, summary={"rows": "2", "note": "night run"})
    return read_at(delete_where(h, "o_orderstatus = 'F'")).select("o_orderkey", "o_totalprice")


@query("""
SELECT * FROM events WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-11'
""")
def delete_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of a history by day: its files are dropped by name, no row of them is read."""
    h = history_of(spark, sf_dir, "events", spec=[("day", "ts")])
    return read_at(drop_partition(h, "day", "ts", "2024-01-10"))


@query("""
SELECT * FROM events WHERE ts IS NULL OR ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-11'
UNION ALL SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-10 12:00:00'
""")
def pick_partition_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged partition delete, picked after main got more rows of that day: only the staged rows go, by key."""
    h = enable_wap(history_of(spark, sf_dir, "events", spec=[("day", "ts")]))
    h = drop_partition(h, "day", "ts", "2024-01-10", wap_id="cleanup")
    h = append(h, table(spark, sf_dir, "events").where(
        "ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-10 12:00:00'"))
    return read_at(cherrypick(h, staged_snapshot_id(h, "cleanup")))
