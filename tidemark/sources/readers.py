"""Sources: files, streams and filtered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import files
from tidemark.plans.fields import col
from tidemark.sources.json_arrays import parsed, records


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def read_json_array(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None,
                    split: bool | None = None) -> DataFrame:
    """Files that each hold one JSON array of objects.

    Types are inferred with a pass over the data unless a schema is given. split: read each file by several tasks, in two
    passes (see `json_arrays`); by default where some file is larger than one task's share. The rows are the same either
    way; a file whose array does not end, or holds something else than objects, is an error when split.
    """
    if split is None:
        share = F.expr(f"{files.bytes_setting(spark, 'spark.sql.files.maxPartitionBytes')}L")
        split = not files.data_files(spark, list(paths), "*").where(F.col("length") > share).isEmpty()
    if split:
        return parsed(records(spark, list(paths)), schema)
    reader = spark.read.option("multiLine", True)
    return (reader if schema is None else reader.schema(schema)).json(list(paths))


def scan(df: DataFrame, where: Column | str | None = None, select: Sequence[str] | None = None) -> DataFrame:
    """Filter and project; the filter may use columns that are not selected."""
    if where is not None:
        df = df.where(where)
    return df if select is None else df.select(*[col(n) for n in select])


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate by position, duplicates kept."""
    for other in others:
        first = first.union(other)
    return first


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                max_files: int | None = None) -> DataFrame:
    """Stream the Parquet files that arrive below `path`, at most `max_files` per batch."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
