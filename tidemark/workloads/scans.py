"""Sources, filtered scans, projections, limits and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import ieee_divide as ieee
from tidemark.functions.scalars import safe_divide as safe
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append
from tidemark.plans.files import work_path
from tidemark.sources.readers import read_json_array, read_parquet, scan, union_all
from tidemark.sources.sinks import write_json_arrays
from tidemark.workloads.registry import history_of, query, table


@query("SELECT * FROM lineitem")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = work_path(spark, "orders-json")
    write_json_arrays(orders, path)
    back = read_json_array(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in orders.schema])


@query("SELECT event_id, event_type, props, l.n AS line FROM events CROSS JOIN (SELECT 7 AS n) l")
def json_split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, with their JSON text inside, as a single JSON array that several tasks read."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    path = work_path(spark, "events-json")
    nested = events.withColumn("nested", F.struct(F.array(F.lit(7)).alias("list"), F.lit('}"{').alias("odd")))
    write_json_arrays(nested.coalesce(1), path)
    back = read_json_array(spark, path, split=True)
    return back.select("event_id", "event_type", "props", F.col("nested.list")[0].cast("int").alias("line"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def scan_filter_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = scan(table(spark, sf_dir, "events"), "ts >= '2024-01-15T00:00:00.000000'")
    return events.select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT ts, props FROM events WHERE event_type = 'error'")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "events"), "event_type = 'error'", ["ts", "props"])


@query("""
SELECT event_type, count(*) AS n FROM (
  SELECT event_type FROM events
  UNION ALL SELECT * FROM (VALUES ('signup'), ('audit')) t(event_type)
) GROUP BY event_type
""")
def inline_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history_of(spark, sf_dir, "events")
    rows = spark.sql("""
        SELECT * FROM VALUES
          (-1L, timestamp_ntz'2024-02-01 07:00:00', 1L, 'signup', 1.0D, '{}'),
          (-2L, timestamp_ntz'2024-02-01 08:00:00', 2L, 'audit', 2.0D, NULL)
        AS t(event_id, ts, user_id, event_type, value, props)
    """)
    h = append(h, rows)
    return read_at(h).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS line_numbers FROM (
  SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'
  UNION ALL SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'
  UNION ALL SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'
) GROUP BY l_returnflag
""")
def union_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    early = lineitem.where("l_shipdate < timestamp_ntz'1995-01-01'")
    late = lineitem.where("l_shipdate >= timestamp_ntz'1995-01-01'")
    return union_all(early, late, late).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("line_numbers")
    )


@query("SELECT l_suppkey, l_shipdate, l_extendedprice, l_quantity FROM lineitem")
def project_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "lineitem"), None, ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"])


@query("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(100).select("event_id", "ts", "value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio FROM lineitem")
def safe_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = safe(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ratio)


_CLASSES = """
CASE WHEN b = 0 AND a = 0 THEN 'nan' WHEN b = 0 AND a > 0 THEN 'inf' WHEN b = 0 THEN '-inf' ELSE 'finite' END
"""


@query(f"""
SELECT kind, count(*) AS n, round(sum(CASE WHEN kind = 'finite' THEN a / nullif(b, 0) END), 4) AS finite_sum FROM (
  SELECT a, b, {_CLASSES} AS kind FROM (
    SELECT l_tax AS a, l_discount AS b FROM lineitem UNION ALL SELECT -l_tax AS a, l_discount AS b FROM lineitem
    UNION ALL SELECT l_tax AS a, l_discount AS b FROM lineitem
  ) s
) t GROUP BY kind
""")
def ieee_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.explode(F.array(F.lit(1.0), F.lit(-1.0), F.lit(1.0))).alias("sign")
    pairs = table(spark, sf_dir, "lineitem").select("l_tax", "l_discount", signs)
    quotient = pairs.select(ieee(F.col("l_tax") * F.col("sign"), F.col("l_discount")).alias("q"))
    finite = F.abs("q") < float("inf")
    kind = F.when(F.isnan("q"), "nan").when(finite, "finite").when(F.col("q") > 0, "inf").otherwise("-inf")
    return quotient.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.when(finite, F.col("q"))), 4).alias("finite_sum")
    )


@query("""
SELECT event_id, event_type AS level, CAST(2 AS INTEGER) AS depth, event_type AS first_line, props AS last_line
FROM events
""")
def array_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("level"), F.array("event_type", "props").alias("call_stack")
    )
    return logs.select(
        "event_id", "level", F.size("call_stack").alias("depth"),
        F.element_at("call_stack", 1).alias("first_line"), F.element_at("call_stack", -1).alias("last_line"),
    )
