"""Partition transforms: derived columns that name the directories rows are written to.

A spec is a list of (transform, column) pairs, e.g. [("day", "ts"), ("identity", "level")].
Derived values never depend on the session time zone, so that a reader prunes exactly the
directories a writer made.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.fields import col

TRANSFORMS = ("identity", "day", "hour")

_MICROS_PER_HOUR = 3_600_000_000


def check_spec(spec: Sequence[tuple[str, str]], schema: T.StructType) -> list[tuple[str, str]]:
    out = []
    for transform, name in spec:
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {transform!r}; use one of {TRANSFORMS}")
        if name not in schema.names:
            raise ValueError(f"no column {name!r} to partition by")
        dtype = schema[name].dataType
        if transform == "hour" and not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"hour needs a timestamp column, {name} is {dtype.simpleString()}")
        if transform == "day" and not isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            raise ValueError(f"day needs a date or timestamp column, {name} is {dtype.simpleString()}")
        out.append((transform, name))
    return out


def derive(transform: str, value: Column, dtype: T.DataType) -> Column:
    """identity: the value; day: a date; hour: whole hours since 1970-01-01 00:00."""
    if transform == "identity":
        return value
    zoned = isinstance(dtype, T.TimestampType)
    hours = (
        F.floor(F.unix_micros(value) / F.lit(_MICROS_PER_HOUR))
        if zoned
        else F.unix_date(F.to_date(value)) * F.lit(24) + F.hour(value)
    )
    if transform == "hour":
        return hours.cast("long")
    return F.date_from_unix_date(F.floor(hours / F.lit(24)).cast("int")) if zoned else F.to_date(value)


def derived_type(transform: str, dtype: T.DataType) -> T.DataType:
    return {"day": T.DateType(), "hour": T.LongType()}.get(transform, dtype)


def hour_start(hours: Column) -> Column:
    """The time an hour number stands for, as a zone-less timestamp."""
    days = F.floor(hours / F.lit(24)).cast("int")
    rest = F.pmod(hours, F.lit(24)).cast("int")
    return F.date_from_unix_date(days).cast("timestamp_ntz") + F.make_dt_interval(hours=rest)


def with_partitions(df: DataFrame, spec: Sequence[tuple[str, str]], names: Sequence[str]) -> DataFrame:
    return df.withColumns({
        out: derive(transform, col(name), df.schema[name].dataType)
        for out, (transform, name) in zip(names, spec)
    })


#: Partitions that a sized write begins with at most. Adaptive execution cuts partitions above the target between the shares
#: of map tasks, so files miss the target only where one map task alone writes more than this many times the target.
MAX_PARTITIONS = 20_000


def write_gathered(df: DataFrame, names: Sequence[str], write: Callable[[DataFrame], None],
                   target_bytes: int | None = None) -> None:
    """Bring rows of one partition value together, then write, without making a hot value one task.

    REBALANCE hashes on the columns (without any, it evens out rows) and adaptive execution splits what is
    above the target size. Merging small shuffle partitions is turned off for partitioned writes: a value
    sits in one of them anyway, so merging would save no file and leave one task to write many directories.
    """
    if not names and not target_bytes:
        return write(df)
    settings = {}
    if names:
        settings["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    if target_bytes:
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(target_bytes)
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(_partitions_for(df, target_bytes))
    with session_settings(df.sparkSession, settings):
        write(df.hint("rebalance", *names))


def write_ranged(df: DataFrame, column: str, write: Callable[[DataFrame], None], target_bytes: int | None = None,
                 files_wanted: int | None = None) -> None:
    """Write rows in ranges of a column, sorted within each file.

    Ranges come from a sample that Spark draws; a frequent value is split over files by the rows' position.
    """
    spread = F.monotonically_increasing_id()
    if files_wanted:
        return write(df.repartitionByRange(files_wanted, col(column), spread).sortWithinPartitions(col(column)))
    settings = {}
    if target_bytes:
        settings["spark.sql.adaptive.advisoryPartitionSizeInBytes"] = str(target_bytes)
        settings["spark.sql.adaptive.coalescePartitions.parallelismFirst"] = "false"
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(_partitions_for(df, target_bytes))
    with session_settings(df.sparkSession, settings):
        write(df.repartitionByRange(col(column), spread).sortWithinPartitions(col(column)))


def _partitions_for(df: DataFrame, target_bytes: int) -> int:
    """How many partitions to begin with: adaptive execution merges small ones but cannot cut one map task's share."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(default, -(-size // target_bytes)), MAX_PARTITIONS)


_LOCK = threading.Lock()
#: By session and option: the value before any write, and the values of the writes that hold it now.
_HELD: dict[tuple[int, str], tuple[str | None, list[tuple[object, str]]]] = {}


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set session options for the duration of a write.

    Writes of several threads may overlap: the option is what the last one that still runs has set, and what it was
    before them once all are done.
    """
    token, session = object(), id(spark)
    with _LOCK:
        for name, value in settings.items():
            before, held = _HELD.setdefault((session, name), (spark.conf.get(name, None), []))
            held.append((token, value))
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _LOCK:
            for name in settings:
                before, held = _HELD[session, name]
                held[:] = [h for h in held if h[0] is not token]
                if held:
                    spark.conf.set(name, held[-1][1])
                    continue
                del _HELD[session, name]
                spark.conf.unset(name) if before is None else spark.conf.set(name, before)
