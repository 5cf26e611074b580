"""Sinks: partitioned and sized Parquet writes, JSON array files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import files
from tidemark.plans.partitioning import check_spec, with_partitions, write_gathered


def partition_columns(spec: Sequence[tuple[str, str]]) -> list[str]:
    """Directory names `write_partitioned` uses."""
    return [f"{name}_{transform}" for transform, name in spec]


def write_partitioned(df: DataFrame, path: str, spec: Sequence[tuple[str, str]], mode: str = "error") -> None:
    """Write Parquet into one directory per partition value; hot values are split over several tasks.

    Every column stays in the files; the derived ones only name directories.
    """
    spec = check_spec(spec, df.schema)
    names = partition_columns(spec)
    out = with_partitions(df, spec, names)
    write_gathered(out, names, lambda rows: rows.write.mode(mode).partitionBy(*names).parquet(path))


def write_sized(df: DataFrame, path: str, target_bytes: int, mode: str = "error") -> int:
    """Write Parquet in files near `target_bytes` and return how many there are.

    Rows are rebalanced by their size as they come out of the plan, so joins, filters and computed rows count as
    what they are; the plan runs once.
    """
    write_gathered(df, [], lambda rows: rows.write.mode(mode).parquet(path), target_bytes)
    return files.size_of(df.sparkSession, [path])[0]


def write_json_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write files that each hold one JSON array, a file per partition.

    Spark has no writer for such files; lines are joined batch by batch in Python.
    """
    def as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = "["
        for batch in batches:
            lines = batch.column(0)
            if len(lines):
                first = pa.array([opener + lines[0].as_py()], lines.type)
                rest = pc.binary_join_element_wise(pa.scalar(",", lines.type), lines.slice(1), "")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([first, rest])], ["value"])
                opener = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opener == "," else "[]"])], ["value"])

    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInArrow(as_array, "value string").write.mode(mode).text(path)
