"""Audits of staged data before it is published."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.analytics import distinct_values
from tidemark.plans.fields import col


class AuditError(ValueError):
    """A set audit found differences."""


def audit_values(df: DataFrame, name: str, expected: Iterable, *, raise_on_fail: bool = False) -> DataFrame:
    """Differences between a column's distinct values and the expected set: (value, problem).

    `problem` is 'missing' or 'unexpected'; no rows means the sets are equal. NULL counts as a value.
    """
    dtype = df.schema[name].dataType
    wanted = df.sparkSession.createDataFrame(
        [(v,) for v in set(expected)], T.StructType([T.StructField("value", dtype)])
    ).withColumn("_wanted", F.lit(True))
    seen = distinct_values(df, name).select(col(name).alias("_seen_value"), F.lit(True).alias("_seen"))
    both = seen.join(wanted, F.col("_seen_value").eqNullSafe(F.col("value")), "full_outer")
    found = both.where(F.col("_seen").isNull() | F.col("_wanted").isNull()).select(
        F.when(F.col("_seen").isNull(), F.col("value")).otherwise(F.col("_seen_value")).alias("value"),
        F.when(F.col("_seen").isNull(), "missing").otherwise("unexpected").alias("problem"),
    )
    if raise_on_fail:
        sample = found.limit(20).collect()  # enough for the message
        if sample:
            listed = ", ".join(f"{r['problem']} {r['value']!r}" for r in sample)
            raise AuditError(f"audit of {name} failed: {listed}")
    return found
