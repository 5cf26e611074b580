"""Streaming: typed projection and exactly-once append to a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.writes import append, load_history
from tidemark.plans.fields import col
from tidemark.plans.files import BehindLog
from tidemark.plans.history import History


def to_sightings(df: DataFrame, character: Column | str, location: Column | str,
                 event_time: Column | str) -> DataFrame:
    """Map keyed records to (character, location, event_time)."""
    def as_col(c: Column | str) -> Column:
        return col(c) if isinstance(c, str) else c

    return df.select(
        as_col(character).cast("string").alias("character"),
        as_col(location).cast("string").alias("location"),
        as_col(event_time).cast("timestamp").alias("event_time"),
    )


def distribute(df: DataFrame, parallelism: int, key: str | None = None) -> DataFrame:
    """`parallelism` write partitions: rows of a key together, but a hot key spread over all of them.

    A key is hot when it has more than 1/parallelism of the rows, so there are fewer hot keys than writers.
    """
    if key is None or parallelism == 1:
        return df.repartition(parallelism)
    sizes = df.groupBy(col(key)).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*")).scalar()
    hot = [r[0] for r in sizes.where(F.col("_n") * parallelism > total).select(col(key)).collect()]
    is_hot = F.lit(False)
    for value in hot:
        is_hot = is_hot | col(key).eqNullSafe(F.lit(value).cast(df.schema[key].dataType))
    # The row's position, not a hash (copies of one row must spread too) and not a random number (a retried
    # task sends rows where it sent them before).
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(parallelism))
    return df.repartition(parallelism, col(key), F.when(is_hot, spread).otherwise(F.lit(0)))


def stream_append(sdf: DataFrame, h: History, checkpoint: str, *, stream_id: str = "stream",
                  key: str | None = None, parallelism: int = 2, interval_ms: int | None = 10_000,
                  branch: str | None = None) -> StreamingQuery:
    """Append every micro-batch of a stream to a history exactly once.

    Each batch is one snapshot that carries the stream's and the batch's id; a batch that is delivered again
    after a restart is found by them and skipped. Where the branch has moved on, by compaction or another writer, the
    batch is appended to what it is now. `interval_ms=None` takes what is there and stops.
    """
    spark, path, branch = sdf.sparkSession, h.path, branch or h.branch
    state = {"h": load_history(spark, path)}

    def done(current: History) -> set[int]:
        return {
            int(c.summary["batch_id"]) for c in map(current.commits.get, current.lineage(current.head(branch)))
            if c.summary.get("stream_id") == stream_id
        }

    committed = done(state["h"])

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id in committed:
            return
        batch = batch.persist()
        try:
            rows = distribute(batch, parallelism, key)
            facts = {"stream_id": stream_id, "batch_id": str(batch_id)}
            while batch_id not in committed:
                try:
                    state["h"] = append(state["h"], rows, branch=branch, summary=facts)
                    committed.add(batch_id)
                except BehindLog:  # maintenance or another writer; an append fits on any head
                    state["h"] = load_history(spark, path)
                    committed.update(done(state["h"]))
        finally:
            batch.unpersist()

    trigger = {"availableNow": True} if interval_ms is None else {"processingTime": f"{interval_ms} milliseconds"}
    return (
        sdf.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
