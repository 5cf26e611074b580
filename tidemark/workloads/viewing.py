"""Persistent views and saved queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.analytics import below_k_stddev
from tidemark.operators.changes import delete_where
from tidemark.operators.writes import append, create_history, ensure_history, load_history
from tidemark.plans.files import work_path
from tidemark.sources.views import create_view
from tidemark.workloads.changes import EARLY, LATE
from tidemark.workloads.registry import query, table

LONG_TRIPS = [("distance", "Trip distance"), ("total", "Total amount"), ("vendor_id", "Vendor ID"), "pickup_date"]
_LONG_SELECT = "SELECT l_quantity, l_extendedprice, l_suppkey, l_shipdate FROM {} WHERE l_quantity > 45"
_LONG_SQL = """
SELECT l_quantity AS distance, l_extendedprice AS total, l_suppkey AS vendor_id, l_shipdate AS pickup_date
FROM lineitem WHERE l_quantity > 45
"""


def _namespace(spark: SparkSession) -> str:
    name = f"trips_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{work_path(spark, name)}'")
    return name


def _over(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The test table by name in a new namespace; its files are used in place."""
    full = f"{_namespace(spark)}.{name}"
    spark.sql(f"CREATE TABLE {full} USING parquet LOCATION '{sf_dir}/{name}.parquet'")
    return full


@query(_LONG_SQL)
def view_long_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _over(spark, sf_dir, "lineitem")
    view = f"{source.split('.')[0]}.long_trips"
    create_view(spark, view, f"SELECT l_suppkey, l_shipdate, l_quantity, l_extendedprice FROM {source} ORDER BY l_quantity",
                ["vendor_id", "pickup_date", "distance", "total"])
    create_view(spark, view, _LONG_SELECT.format(source) + " ORDER BY l_extendedprice, l_quantity", LONG_TRIPS,
                replace=True)
    return spark.table(view)


@query("""
SELECT c_acctbal AS total, c_custkey AS vendor_id, c_name AS vendor_name FROM customer WHERE c_acctbal < 0
""")
def view_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _over(spark, sf_dir, "customer")
    view = f"{source.split('.')[0]}.negative_amounts"
    create_view(spark, view, f"SELECT c_acctbal, c_custkey, c_name FROM {source} WHERE c_acctbal < 0 ORDER BY c_acctbal",
                [("total", "Total amount"), ("vendor_id", "Vendor ID"), "vendor_name"], replace=True)
    return spark.table(view)


@query(_LONG_SQL)
def view_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    namespace = _namespace(spark)
    lineitem.where(EARLY).write.saveAsTable(f"{namespace}.lineitem")
    create_view(spark, f"{namespace}.long_trips", _LONG_SELECT.format(f"{namespace}.lineitem"), LONG_TRIPS)
    lineitem.where(LATE).write.insertInto(f"{namespace}.lineitem")
    return spark.table(f"{namespace}.long_trips")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def named_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create a history by name, open it by name, read it as a table in SQL."""
    name = f"{_namespace(spark)}.events"
    create_history(table(spark, sf_dir, "events"), name)
    assert load_history(spark, name).head() == 1
    return spark.sql(f"SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM {name} GROUP BY event_type")


@query("""
SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR o_orderstatus IS DISTINCT FROM 'F'
""")
def named_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensure by name, delete and append through the name; the table of that name shows both."""
    orders = table(spark, sf_dir, "orders")
    name = f"{_namespace(spark)}.orders"
    append(ensure_history(spark, name, orders.schema), orders.where("o_orderdate < timestamp_ntz'1998-01-01'"))
    delete_where(load_history(spark, name), "o_orderstatus = 'F'")
    append(ensure_history(spark, name, "unused int"), orders.where(
        "o_orderdate >= timestamp_ntz'1998-01-01' OR o_orderdate IS NULL AND NOT o_orderstatus <=> 'F'"))
    return spark.table(name)


@query(_LONG_SQL)
def view_history_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view over a history, read by another session after an append that came later."""
    lineitem = table(spark, sf_dir, "lineitem")
    namespace = _namespace(spark)
    h = create_history(lineitem.where(EARLY), f"{namespace}.lineitem")
    create_view(spark, f"{namespace}.long_trips", _LONG_SELECT.format(f"{namespace}.lineitem"), LONG_TRIPS)
    append(h, lineitem.where(LATE))
    return spark.newSession().table(f"{namespace}.long_trips")


@query("""
WITH tips AS (SELECT event_id, value FROM events)
SELECT event_id, value FROM tips WHERE value > 0 AND value < (SELECT stddev_pop(value) FROM tips) * 3
""")
def named_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"tips_{uuid.uuid4().hex[:12]}"
    table(spark, sf_dir, "events").select("event_id", "value").createOrReplaceTempView(name)
    return below_k_stddev(spark.table(name), "value", 3)
