"""Scalar functions whose zero-divisor rules differ from plain `/`, which raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as floating point: x/0 is +-infinity by the signs, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    # -0.0 equals 0.0 to SQL; only its text tells the sign.
    negative = (a < 0) != b.cast("string").startswith("-")
    by_zero = (
        F.when((a == 0) | F.isnan(a), nan).when(negative, -inf).otherwise(inf)
    )
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(
        F.try_divide(a, b)
    )
