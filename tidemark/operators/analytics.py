"""Aggregates, outlier trimming, histograms and column profiles.

A statistic of the whole column reaches each row as a scalar subquery: it is computed once with partial
aggregation and used as a constant, so rows are neither joined nor gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.fields import col


def group_count(df: DataFrame, *names: str, alias: str = "count") -> DataFrame:
    return df.groupBy(*[col(n) for n in names]).agg(F.count("*").alias(alias))


def distinct_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(col(name)).distinct()


def below_k_stddev(df: DataFrame, name: str, k: float = 3) -> DataFrame:
    """Rows with 0 < x < k population standard deviations of x."""
    limit = df.agg(F.stddev_pop(col(name))).scalar() * F.lit(k)
    return df.where((col(name) > 0) & (col(name) < limit))


def zscore(df: DataFrame, name: str, alias: str = "zscore") -> DataFrame:
    """Add each row's distance from the mean in population standard deviations.

    NULL where x is NULL or the column is constant. A NaN makes every score NaN: filter those first.
    """
    stats = df.agg(F.struct(F.avg(col(name)).alias("mean"), F.stddev_pop(col(name)).alias("dev"))).scalar()
    return df.withColumn(alias, F.try_divide(col(name) - stats["mean"], stats["dev"]))


def trim_outliers(df: DataFrame, name: str, k: float = 3, floor: float | None = 0) -> DataFrame:
    """Rows with |z-score| < k, then x > floor."""
    kept = zscore(df, name, "_zscore").where(F.abs("_zscore") < k).drop("_zscore")
    return kept if floor is None else kept.where(col(name) > floor)


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]: bin, low, high, count. Empty bins are listed; NULL, NaN and infinities are left out.

    A constant column is spread over a range of one around its value.
    """
    if bins < 1:
        raise ValueError("bins must be at least 1")
    values = df.select(col(name).cast("double").alias("_x")).where(F.abs("_x") < float("inf"))
    edges = values.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select(
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")).alias("span"),
    )
    edge = edges.select(F.struct("lo", "span")).scalar()
    width = edge["span"] / F.lit(bins)
    bin_no = F.least(F.floor((F.col("_x") - edge["lo"]) / width), F.lit(bins - 1).cast("long"))
    counts = values.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("_n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(  # at most `bins` rows on either side
        "bin",
        (edge["lo"] + F.col("bin") * width).alias("low"),
        (edge["lo"] + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("count"),
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, non-null count. One pass over the data."""
    counts = df.agg(*[F.count(col(f.name)).alias(f"_c{i}") for i, f in enumerate(df.schema)])
    return unpivot(counts, df.schema, {"non_null_count": lambda i: F.col(f"_c{i}")})


def unpivot(row_per_group: DataFrame, schema: T.StructType, values: dict, keep: Sequence[str] = ()) -> DataFrame:
    """Turn wide per-column aggregates into one row per (group, column)."""
    def entry(i: int, f: T.StructField) -> Column:
        return F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            *[value(i).alias(name) for name, value in values.items()],
        )

    entries = F.array(*[entry(i, f) for i, f in enumerate(schema)])
    return row_per_group.select(*keep, F.explode(entries).alias("_e")).select(*keep, "_e.*")
