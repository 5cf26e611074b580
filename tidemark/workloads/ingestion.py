"""Streaming append and queries beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.maintenance import compact
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import ensure_history, load_history
from tidemark.plans.files import work_path
from tidemark.plans.history import History
from tidemark.sources.readers import read_stream
from tidemark.streaming.ingest import stream_append as append_stream
from tidemark.streaming.ingest import to_sightings
from tidemark.workloads.registry import query, table

SIGHTINGS = "character string not null, location string not null, event_time timestamp not null"


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream: four files, two per micro-batch."""
    events = table(spark, sf_dir, "events")
    path = work_path(spark, "events-arriving")
    events.repartition(4).write.parquet(path)
    return read_stream(spark, path, events.schema, max_files=2)


def _run(spark: SparkSession, sf_dir: str) -> History:
    target = ensure_history(spark, work_path(spark, "sightings"), SIGHTINGS)
    rows = to_sightings(_arriving(spark, sf_dir), F.col("user_id"), "event_type", "ts")
    checkpoint = work_path(spark, "sightings-checkpoint")
    append_stream(rows, target, checkpoint, key="character", parallelism=2, interval_ms=None).awaitTermination()
    return load_history(spark, target.path)


_SIGHTINGS_SQL = """
SELECT CAST(user_id AS VARCHAR) AS "character", event_type AS location, ts AS event_time FROM events
"""


def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query(_SIGHTINGS_SQL)
def stream_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection alone, over the table a stream would deliver."""
    return _naive(to_sightings(table(spark, sf_dir, "events"), F.col("user_id"), "event_type", "ts"))


@query(_SIGHTINGS_SQL)
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(read_at(_run(spark, sf_dir)))


@query("""
SELECT event_type AS location, count(*) AS n, count(DISTINCT user_id) AS "characters" FROM events GROUP BY event_type
""")
def stream_then_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_at(_run(spark, sf_dir)).groupBy("location").agg(
        F.count("*").alias("n"), F.countDistinct("character").alias("characters")
    )


@query(_SIGHTINGS_SQL)
def stream_then_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, _ = compact(_run(spark, sf_dir))
    return _naive(read_at(h))


@query(_SIGHTINGS_SQL)
def stream_to_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into a history that is made if its name is not there yet, read as a table by another session."""
    namespace = f"lor_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace} LOCATION '{work_path(spark, namespace)}'")
    target = ensure_history(spark, f"{namespace}.sightings", SIGHTINGS)
    rows = to_sightings(_arriving(spark, sf_dir), F.col("user_id"), "event_type", "ts")
    append_stream(rows, target, work_path(spark, "checkpoint"), key="character", interval_ms=None).awaitTermination()
    return _naive(spark.newSession().table(f"{namespace}.sightings"))
