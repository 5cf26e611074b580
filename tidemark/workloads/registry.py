"""Where workload modules register their queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.writes import create_history
from tidemark.plans.files import work_path
from tidemark.plans.history import History

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL twin if there is one."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history_of(spark: SparkSession, sf_dir: str, name: str, **options) -> History:
    """A new history in the shared work folder, loaded with a whole test table."""
    return create_history(table(spark, sf_dir, name), work_path(spark, name), **options)


def hour(n: int) -> datetime:
    """A fixed commit time, n hours into 2024, where a query compares times."""
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=n)
