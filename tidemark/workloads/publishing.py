"""Write, audit, publish: staged snapshots and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import snapshots as snap
from tidemark.operators.analytics import group_count
from tidemark.operators.audit import audit_values
from tidemark.operators.maintenance import compact
from tidemark.operators.changes import delete_where
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history
from tidemark.plans.files import work_path
from tidemark.plans.history import History
from tidemark.workloads.registry import history_of, query, table

SESSION = "audit-session-1"
EXPECTED = {"click", "purchase", "signup", "view"}

_ALL = "SELECT event_type, count(*) AS permit_cnt FROM events GROUP BY event_type"
_KEPT = f"SELECT * FROM ({_ALL}) WHERE event_type IS DISTINCT FROM 'error'"


def _counts(df: DataFrame) -> DataFrame:
    return group_count(df, "event_type", alias="permit_cnt")


def _staged(spark: SparkSession, sf_dir: str) -> History:
    h = snap.enable_wap(history_of(spark, sf_dir, "events"))
    return delete_where(h, "event_type = 'error'", wap_id=SESSION)


def _branched(spark: SparkSession, sf_dir: str) -> History:
    h = snap.enable_wap(history_of(spark, sf_dir, "events"))
    h = snap.create_branch(h, "etl_job_42")
    return delete_where(h, "event_type = 'error'", branch="etl_job_42")


@query(_ALL)
def wap_staged_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(read_at(_staged(spark, sf_dir)))


@query("""
SELECT CAST(2 AS BIGINT) AS snapshot_id, 'delete' AS operation,
       count(*) FILTER (WHERE event_type = 'error') AS removed_rows FROM events
""")
def find_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = snap.find_staged(_staged(spark, sf_dir), SESSION)
    return found.select("snapshot_id", "operation", F.col("summary")["removed_rows"].cast("long").alias("removed_rows"))


@query(_KEPT)
def wap_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _staged(spark, sf_dir)
    staged = snap.staged_snapshot_id(h, SESSION)
    audit_values(read_at(h, snapshot_id=staged), "event_type", EXPECTED, raise_on_fail=True)
    return _counts(read_at(snap.cherrypick(h, staged)))


@query("""
SELECT event_type, count(*) AS permit_cnt FROM (
  SELECT event_type FROM events WHERE event_type IS DISTINCT FROM 'error'
  UNION ALL SELECT event_type FROM events WHERE event_type IS DISTINCT FROM 'view'
) GROUP BY event_type
""")
def wap_publish_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged delete is picked after main has moved on: rows appended since are not its concern."""
    h = _staged(spark, sf_dir)
    h = append(h, table(spark, sf_dir, "events").where("event_type IS DISTINCT FROM 'view'"))
    return _counts(read_at(snap.cherrypick(h, snap.staged_snapshot_id(h, SESSION))))


@query(_KEPT)
def wap_publish_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction between staging and publishing moves the rows to other files but changes none."""
    h, _ = compact(_staged(spark, sf_dir))
    return _counts(read_at(snap.cherrypick(h, snap.staged_snapshot_id(h, SESSION))))


@query("""
SELECT event_type, count(*) AS permit_cnt FROM events
WHERE event_type IS DISTINCT FROM 'error' AND event_type IS DISTINCT FROM 'view' GROUP BY event_type
""")
def wap_publish_other_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete of other rows meanwhile is no conflict."""
    h = delete_where(_staged(spark, sf_dir), "event_type = 'view'")
    return _counts(read_at(snap.cherrypick(h, snap.staged_snapshot_id(h, SESSION))))


@query(_KEPT)
def branch_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(read_at(_branched(spark, sf_dir), branch="etl_job_42"))


@query(_ALL)
def main_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(read_at(_branched(spark, sf_dir), branch="main"))


@query(f"""
SELECT 'session' AS read_from, event_type, permit_cnt FROM ({_KEPT})
UNION ALL SELECT 'unset', event_type, permit_cnt FROM ({_ALL})
""")
def branch_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = snap.create_branch(history_of(spark, sf_dir, "events"), "etl_job_42")
    h = snap.on_branch(h, "etl_job_42")
    h = delete_where(h, "event_type = 'error'")
    inside = _counts(read_at(h)).select(F.lit("session").alias("read_from"), "event_type", "permit_cnt")
    outside = _counts(read_at(snap.on_branch(h, "main")))
    return inside.union(outside.select(F.lit("unset"), "event_type", "permit_cnt"))


@query("""
SELECT event_type, count(*) AS permit_cnt FROM events
WHERE event_type IS DISTINCT FROM 'error' AND event_type IS DISTINCT FROM 'view' GROUP BY event_type
""")
def branch_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = delete_where(_branched(spark, sf_dir), "event_type = 'view'", branch="etl_job_42")
    return _counts(read_at(snap.fast_forward(h, "main", "etl_job_42")))


@query(_ALL)
def branch_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(read_at(snap.drop_branch(_branched(spark, sf_dir), "etl_job_42")))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM (
  SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'
  UNION ALL SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type IS DISTINCT FROM 'error'
) GROUP BY event_type
""")
def cherrypick_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One staged load is picked, another stays staged and out of sight."""
    events = table(spark, sf_dir, "events")
    late = events.where("ts >= timestamp_ntz'2024-01-15'")
    h = create_history(events.where("ts < timestamp_ntz'2024-01-15'"), work_path(spark, "events"))
    h = snap.enable_wap(h)
    h = append(h, late.where("event_type IS DISTINCT FROM 'error'"), wap_id="good")
    h = append(h, late.where("event_type = 'error'"), wap_id="bad")
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "good"))
    return read_at(h).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
