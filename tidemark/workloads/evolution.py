"""Schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evolve
from tidemark.operators.analytics import profile
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history
from tidemark.plans.files import work_path
from tidemark.workloads.registry import history_of, query, table


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice AS fare,
       l_discount AS distance, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem
""")
def schema_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evolve.rename_column(history_of(spark, sf_dir, "lineitem"), "l_extendedprice", "fare")
    return read_at(evolve.rename_column(h, "l_discount", "distance"))


@query("""
SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM supplier
UNION ALL SELECT -s_suppkey - 1, s_name, s_nationkey, s_acctbal FROM supplier
""")
def schema_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column is dropped and another one added under its name: older rows do not show the old values."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    h = evolve.drop_column(create_history(supplier, work_path(spark, "supplier")), "s_acctbal")
    h = evolve.add_column(h, "s_acctbal", "double")
    return read_at(append(h, supplier.withColumn("s_suppkey", -F.col("s_suppkey") - 1)))


@query("""
SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part
UNION ALL SELECT -p_partkey - 1, CAST(p_size AS BIGINT) + 10000000000 FROM part
""")
def schema_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evolve.retype_column(history_of(spark, sf_dir, "part"), "p_size", "bigint")
    h = evolve.retype_column(h, "p_retailprice", "double")
    more = table(spark, sf_dir, "part").withColumns({
        "p_partkey": -F.col("p_partkey") - 1, "p_size": F.col("p_size").cast("long") + 10_000_000_000,
    })
    return read_at(append(h, more)).select("p_partkey", "p_size")


@query("""
SELECT position, "column", non_null_count FROM (
  SELECT 1 AS position, 'p_partkey' AS "column", count(p_partkey) AS non_null_count FROM part
  UNION ALL SELECT 2, 'p_name', count(p_name) FROM part
  UNION ALL SELECT 3, 'p_brand', count(p_brand) FROM part
  UNION ALL SELECT 4, 'p_retailprice', count(p_retailprice) FROM part
  UNION ALL SELECT 5, 'p_type', count(p_type) FROM part
  UNION ALL SELECT 6, 'p_size', count(p_size) FROM part
)
""")
def schema_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evolve.move_column(history_of(spark, sf_dir, "part"), "p_retailprice", after="p_brand")
    return profile(read_at(h)).select("position", "column", "non_null_count")


@query("""
SELECT o_orderkey, o_totalprice, CAST(NULL AS FLOAT) AS discount, o_orderdate FROM orders
UNION ALL SELECT -o_orderkey - 1, o_totalprice, CAST(0.25 AS FLOAT), o_orderdate FROM orders
""")
def schema_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evolve.add_column(history_of(spark, sf_dir, "orders"), "discount", "float", after="o_totalprice")
    more = table(spark, sf_dir, "orders").withColumns({
        "o_orderkey": -F.col("o_orderkey") - 1, "discount": F.lit(0.25).cast("float"),
    })
    return read_at(append(h, more)).select("o_orderkey", "o_totalprice", "discount", "o_orderdate")


@query("""
SELECT c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS tier FROM customer
UNION ALL SELECT -c_custkey - 1, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END FROM customer
""")
def schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "customer").withColumns({
        "c_custkey": -F.col("c_custkey") - 1,
        "tier": F.when(F.col("c_acctbal") < 0, "debt").otherwise("ok"),
    })
    h = evolve.union_schema(history_of(spark, sf_dir, "customer"), more.schema)
    return read_at(append(h, more)).select("c_custkey", "c_acctbal", "tier")


@query("""
SELECT * FROM (
  SELECT 1 AS position, 's_suppkey' AS col_name, 'bigint' AS data_type, CAST(NULL AS VARCHAR) AS comment,
         count(s_suppkey) AS non_null_count FROM supplier
  UNION ALL SELECT 2, 'vendor', 'string', 'Vendor name', count(s_name) FROM supplier
  UNION ALL SELECT 3, 'rating', 'float', NULL, count(CAST(NULL AS FLOAT)) FROM supplier
  UNION ALL SELECT 4, 's_nationkey', 'bigint', NULL, count(s_nationkey) FROM supplier
  UNION ALL SELECT 5, 's_acctbal', 'double', NULL, count(s_acctbal) FROM supplier
)
""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evolve.rename_column(history_of(spark, sf_dir, "supplier"), "s_name", "vendor")
    h = evolve.comment_column(h, "vendor", "Vendor name")
    h = evolve.add_column(h, "rating", "float", after="vendor")
    h = evolve.retype_column(h, "s_nationkey", "bigint")
    filled = profile(read_at(h)).select("position", "non_null_count")
    return evolve.describe(h).join(filled, "position").select(
        "position", "col_name", "data_type", "comment", "non_null_count"
    )
