"""Snapshots, logs, time travel and rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import snapshots as snap
from tidemark.operators.changes import delete_where, update_where
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history
from tidemark.plans.files import work_path
from tidemark.plans.history import History
from tidemark.workloads.changes import EARLY, LATE, with_ratio
from tidemark.workloads.registry import history_of, hour, query, table


def _parent() -> Column:
    # The first snapshot has no parent; shown as 0 so that the column is an integer to every reader.
    return F.coalesce("parent_id", F.lit(0)).cast("long").alias("parent_id")


def _changed_lineitem(spark: SparkSession, sf_dir: str) -> History:
    """1: rows shipped before 1995. 2: the others. 3: delete quantity > 45. 4: update flag R to Q."""
    lineitem = table(spark, sf_dir, "lineitem")
    h = create_history(lineitem.where(EARLY), work_path(spark, "lineitem"), at=hour(1))
    h = append(h, lineitem.where(LATE), at=hour(2))
    h = delete_where(h, "l_quantity > 45", at=hour(3))
    return update_where(h, {"l_returnflag": F.lit("Q")}, "l_returnflag = 'R'", at=hour(4))


_EARLY = "l_shipdate < TIMESTAMP '1995-01-01'"
_KEPT = "NOT coalesce(l_quantity > 45, false)"
_LOG = f"""
SELECT * FROM (
  SELECT CAST(1 AS BIGINT) AS snapshot_id, CAST(0 AS BIGINT) AS parent_id, 'append' AS operation,
         count(*) AS added_rows, CAST(0 AS BIGINT) AS removed_rows, count(*) AS total_rows
  FROM lineitem WHERE {_EARLY}
  UNION ALL SELECT 2, 1, 'append', count(*) FILTER (WHERE NOT {_EARLY}), 0, count(*) FROM lineitem
  UNION ALL SELECT 3, 2, 'delete', 0, count(*) FILTER (WHERE NOT ({_KEPT})), count(*) FILTER (WHERE {_KEPT})
  FROM lineitem
  UNION ALL SELECT 4, 3, 'overwrite', count(*) FILTER (WHERE {_KEPT} AND l_returnflag = 'R'),
         count(*) FILTER (WHERE {_KEPT} AND l_returnflag = 'R'), count(*) FILTER (WHERE {_KEPT}) FROM lineitem
)
"""


def _log_rows(df: DataFrame) -> DataFrame:
    facts = [F.col("summary")[n].cast("long").alias(n) for n in ("added_rows", "removed_rows", "total_rows")]
    return df.select("snapshot_id", _parent(), "operation", *facts)


@query(_LOG)
def snapshots_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(snap.snapshots(_changed_lineitem(spark, sf_dir)))


@query(_LOG + " ORDER BY snapshot_id DESC")
def snapshots_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(snap.snapshots(_changed_lineitem(spark, sf_dir)).orderBy(F.desc("committed_at")))


@query(f"SELECT * FROM ({_LOG}) WHERE snapshot_id = 4")
def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(snap.current_snapshot(_changed_lineitem(spark, sf_dir)))


@query(f"""
SELECT * FROM (
  SELECT CAST(1 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS snapshot_id, CAST(0 AS BIGINT) AS parent_id,
         true AS is_current_ancestor, count(*) AS total_rows FROM lineitem WHERE {_EARLY}
  UNION ALL SELECT 2, 2, 1, true, count(*) FROM lineitem
  UNION ALL SELECT 3, 3, 2, false, count(*) FROM lineitem WHERE {_KEPT}
  UNION ALL SELECT 4, 4, 3, false, count(*) FROM lineitem WHERE {_KEPT}
  UNION ALL SELECT 5, 2, 1, true, count(*) FROM lineitem
)
""")
def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = snap.rollback(_changed_lineitem(spark, sf_dir), 2)
    sizes = snap.snapshots(h).select("snapshot_id", F.col("summary")["total_rows"].cast("long").alias("total_rows"))
    log = snap.history(h).select("seq", "snapshot_id", _parent(), "is_current_ancestor")
    return log.join(sizes, "snapshot_id").select("seq", "snapshot_id", "parent_id", "is_current_ancestor", "total_rows")


@query("""
SELECT 'main' AS name, 'BRANCH' AS "type", CAST(1 AS BIGINT) AS snapshot_id, count(*) AS total_rows FROM events
UNION ALL SELECT 'etl_job_42', 'BRANCH', 2, count(*) FROM events WHERE NOT coalesce(event_type = 'error', false)
""")
def refs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = snap.create_branch(history_of(spark, sf_dir, "events"), "etl_job_42")
    h = delete_where(h, "event_type = 'error'", branch="etl_job_42")
    sizes = snap.snapshots(h).select("snapshot_id", F.col("summary")["total_rows"].cast("long").alias("total_rows"))
    return snap.refs(h).join(sizes, "snapshot_id").select("name", "type", "snapshot_id", "total_rows")


@query(f"""
SELECT * FROM (
  SELECT 1 AS snapshot, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity
  FROM lineitem WHERE {_EARLY} GROUP BY l_returnflag
  UNION ALL SELECT 2, l_returnflag, count(*), round(sum(l_quantity), 2) FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 3, l_returnflag, count(*), round(sum(l_quantity), 2)
  FROM lineitem WHERE {_KEPT} GROUP BY l_returnflag
  UNION ALL SELECT 4, replace(l_returnflag, 'R', 'Q'), count(*), round(sum(l_quantity), 2)
  FROM lineitem WHERE {_KEPT} GROUP BY 2
)
""")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _changed_lineitem(spark, sf_dir)
    parts = [
        read_at(h, snapshot_id=s).groupBy(F.lit(s).alias("snapshot"), "l_returnflag").agg(
            F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
        )
        for s in (1, 2, 3, 4)
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice AS fare, l_discount AS distance,
       CAST(NULL AS FLOAT) AS fare_per_distance_unit FROM lineitem
""")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = delete_where(with_ratio(spark, sf_dir), "fare_per_distance_unit IS NULL OR distance > 0.05")
    first = snap.history(h).orderBy("seq").limit(1).first()["snapshot_id"]
    h = snap.rollback(h, first)
    return read_at(h).select("l_orderkey", "l_linenumber", "fare", "distance", "fare_per_distance_unit")
