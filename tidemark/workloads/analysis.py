"""Aggregates, outliers, histograms, profiles and audits over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import analytics
from tidemark.operators.audit import audit_values as audit
from tidemark.operators.snapshots import read_at
from tidemark.operators.stats import file_stats as stats_of_files
from tidemark.operators.writes import reconcile as compare_rows
from tidemark.workloads.registry import history_of, query, table


@query("SELECT count(*) AS cnt FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("cnt"))


@query("SELECT event_type, count(*) AS permit_cnt FROM events GROUP BY event_type")
def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.group_count(table(spark, sf_dir, "events"), "event_type", alias="permit_cnt")


@query("SELECT DISTINCT event_type FROM events")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.distinct_values(table(spark, sf_dir, "events"), "event_type")


@query("""
WITH s AS (SELECT stddev_pop(value) AS dev FROM events)
SELECT event_id, value FROM events, s WHERE value > 0 AND value < dev * 3
""")
def within_3_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.below_k_stddev(table(spark, sf_dir, "events"), "value", 3).select("event_id", "value")


@query("""
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z
FROM events
""")
def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = analytics.zscore(table(spark, sf_dir, "events"), "value", "z")
    return scored.select("event_id", F.round("z", 6).alias("z"))


@query("""
SELECT event_id, value FROM events
WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) < 3 AND value > 0
""")
def trim_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trim_outliers(table(spark, sf_dir, "events"), "value", 3, 0).select("event_id", "value")


def _histogram_sql(source: str, bins: int) -> str:
    return f"""
WITH v AS ({source}), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / {bins} AS w FROM v),
c AS (
  SELECT least(CAST(floor((x - lo) / w) AS BIGINT), {bins - 1}) AS bin, count(*) AS n FROM v, e GROUP BY 1
)
SELECT r.bin AS bin, round(lo + r.bin * w, 6) AS low, round(lo + (r.bin + 1) * w, 6) AS high,
       coalesce(c.n, 0) AS "count"
FROM (SELECT range AS bin FROM range({bins})) r LEFT JOIN c ON c.bin = r.bin, e
"""


def _histogram(df: DataFrame, bins: int) -> DataFrame:
    return analytics.histogram(df, "value", bins).select(
        "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count"
    )


@query(_histogram_sql("SELECT value AS x FROM events", 10))
def histogram_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(table(spark, sf_dir, "events"), 10)


@query(_histogram_sql("SELECT value AS x FROM events", 22))
def histogram_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(table(spark, sf_dir, "events"), 22)


@query(_histogram_sql("""
  SELECT value AS x FROM events WHERE value > 0 AND value < (SELECT stddev_pop(value) FROM events) * 3
""", 50))
def histogram_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(analytics.below_k_stddev(table(spark, sf_dir, "events"), "value", 3), 50)


@query("""
SELECT * FROM (
  SELECT 1 AS position, 'event_id' AS "column", 'bigint' AS "type", count(event_id) AS non_null_count FROM events
  UNION ALL SELECT 2, 'ts', 'timestamp_ntz', count(ts) FROM events
  UNION ALL SELECT 3, 'user_id', 'bigint', count(user_id) FROM events
  UNION ALL SELECT 4, 'event_type', 'string', count(event_type) FROM events
  UNION ALL SELECT 5, 'value', 'double', count(value) FROM events
  UNION ALL SELECT 6, 'props', 'string', count(props) FROM events
)
""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile(table(spark, sf_dir, "events"))


@query("""
SELECT count(*) AS source_rows, count(*) AS written_rows, CAST(0 AS BIGINT) AS missing_rows,
       CAST(0 AS BIGINT) AS unexpected_rows FROM lineitem
""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_rows(table(spark, sf_dir, "lineitem"), read_at(history_of(spark, sf_dir, "lineitem")))


@query("""
WITH expected AS (SELECT * FROM (VALUES ('click'), ('purchase'), ('signup'), ('refund')) t(v)),
seen AS (SELECT DISTINCT event_type AS v FROM events)
SELECT v AS "value", 'missing' AS problem FROM expected WHERE v NOT IN (SELECT v FROM seen)
UNION ALL SELECT v, 'unexpected' FROM seen WHERE v NOT IN (SELECT v FROM expected)
""")
def audit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "events"), "event_type", {"click", "purchase", "signup", "refund"})


_LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


# DuckDB takes bounds from the footer, where a zero may have a sign; adding 0 drops it.
@query(" UNION ALL ".join(
    f"""SELECT 'PARQUET' AS file_format, count(*) AS record_count, '{c}' AS "column", count(*) - count({c}) AS null_count,
    CAST(min({c}){" + 0" if c in ("l_discount", "l_tax") else ""} AS VARCHAR) AS lower_bound, CAST(max({c}) AS VARCHAR) AS upper_bound FROM lineitem"""
    for c in _LINEITEM
))
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stats_of_files(table(spark, sf_dir, "lineitem"))
    return stats.select("file_format", "record_count", "column", "null_count", "lower_bound", "upper_bound")
