"""Facts and column bounds of data files, gathered once and kept beside the data.

One row per file: its name below the rows folder, size, rows, and for each column (by field id) the number of nulls and
the least and greatest value in the column's own type. They are an aggregate over a batch as it was written, so they need
neither the writer's help nor footers; later readers use them in place of the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import files
from tidemark.plans.fields import field_id

FACTS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("file_path", T.StringType()),
    T.StructField("file_size_in_bytes", T.LongType()), T.StructField("record_count", T.LongType()),
])


def ordered(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _columns(f: T.StructField) -> list[T.StructField]:
    out = [T.StructField(f"n{field_id(f)}", T.LongType())]
    if ordered(f.dataType):
        out += [T.StructField(f"{tag}{field_id(f)}", f.dataType) for tag in ("lo", "hi")]
    return out


def file_columns() -> list[Column]:
    return [files.file_name().alias("_file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size")]


def aggregated(scan: DataFrame, schema: T.StructType, columns: list[str]) -> DataFrame:
    """The facts of each file in a scan that holds `columns` (one per field of the schema) and `file_columns`."""
    out = [F.count("*").alias("record_count")]
    for f, name in zip(schema, columns):
        value = F.col(name)
        parts = [F.count_if(value.isNull())]
        if ordered(f.dataType):
            parts += [F.min(value), F.max(value)]
        out += [part.alias(c.name) for part, c in zip(parts, _columns(f))]
    per_file = scan.groupBy(
        F.col("_file").alias("file"), F.col("_path").alias("file_path"), F.col("_size").alias("file_size_in_bytes"))
    return per_file.agg(*out)


def scanned(h, spec_of: dict[int, int], chosen: Iterable[Column] = ()) -> DataFrame:
    """Facts of the stored rows of batches, from a scan; spec_of: the spec each batch was written under."""
    by_spec: dict[int, list[int]] = {}
    for b, s in spec_of.items():
        by_spec.setdefault(s, []).append(b)
    values = [f"_v{i}" for i in range(len(h.schema))]  # user columns by position: they may carry any name
    names = ["_added_in", "_row_id", *values, "_file", "_path", "_size"]
    scans = [h.scan(s, members, extra=file_columns(), chosen=chosen).toDF(*names) for s, members in sorted(by_spec.items())]
    return aggregated(reduce(DataFrame.union, scans), h.schema, values)


def gather(h, batches: list[int], spec_of: dict[int, int] | None = None, chosen: Iterable[Column] = ()) -> None:
    """Aggregate the files of these batches and keep the result."""
    if not batches:
        return
    spec_of = spec_of or {b: h.commits[b].spec_id for b in batches}
    batch = F.regexp_extract("file", r"/batch=(\d+)/", 1).cast("long").alias("batch")
    found = scanned(h, spec_of, chosen)
    # one small row per file: as many tasks as adaptive execution finds worth it
    found.select("*", batch).write.partitionBy("batch").mode("append").parquet(_path(h))


def _path(h) -> str:
    return f"{h.path}/stats"


def kept(h, batches: Iterable[int]) -> DataFrame | None:
    """What has been gathered for these batches; None if nothing ever was. A file has one row at most."""
    if not files.exists(h.spark, _path(h)):
        return None
    schema = T.StructType(FACTS.fields + [c for f in h.schema for c in _columns(f)] + [T.StructField("batch", T.LongType())])
    found = h.spark.read.schema(schema).parquet(_path(h)).where(F.col("batch").isin(list(batches)))
    return found.dropDuplicates(["file"])


def files_outside(h, seen, column: T.StructField, *bounds: tuple) -> list[str]:
    """Visible files that hold no value within the bounds, as far as gathered facts tell.

    bounds: (operator.ge or operator.lt, literal). The driver sees names of files that are left out, nothing else.
    """
    found = kept(h, seen.batches) if ordered(column.dataType) else None
    if found is None:
        return []
    low, high = F.col(f"lo{field_id(column)}"), F.col(f"hi{field_id(column)}")
    meets = F.lit(True)
    for compare, value in bounds:
        meets = meets & (compare(high, value) if compare.__name__ == "ge" else compare(low, value))
    # a column added later has no bounds, and none but null values, in older files
    return [r["file"] for r in found.where(~F.coalesce(meets, F.lit(False))).select("file").collect()]
