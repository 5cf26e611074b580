"""Statistics of data files and partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.analytics import unpivot
from tidemark.plans import bounds, files
from tidemark.plans.fields import col, field_id, make_field
from tidemark.plans.history import History, Visible
from tidemark.plans.partitioning import check_spec, hour_start, with_partitions

_FILE = ["file_path", "file_format", "file_size_in_bytes", "record_count"]


def _by_spec(h: History, branch: str | None) -> dict[int, DataFrame]:
    """Per spec in use, the stored rows of a branch with the file each is in."""
    seen, batches = h.visible(h.head(branch)), {}
    for b in seen.batches:
        batches.setdefault(h.commits[b].spec_id, []).append(b)
    path = F.col("_metadata.file_path").alias("file_path")
    return {
        s: h.scan(s, members, extra=[path], chosen=h.visible_files(seen, members))
        for s, members in sorted(batches.items())
    }


def gather_stats(h: History, branch: str | None = None, *, always: bool = False) -> History:
    """Gather facts and bounds of the files a branch shows, where they are lacking, and keep them beside the data.

    `file_stats` then reads them in place of the data, and `read_range` skips files by them. always: gather them with
    every write from now on too, from the files just written.
    """
    seen = h.visible(h.head(branch))
    lacking = _lacking(h, seen)
    if lacking:
        batches = sorted({int(f.split("/")[1].removeprefix("batch=")) for f in lacking})
        bounds.gather(h, batches, chosen=[files.file_name().isin(lacking)])
    return h.save(properties={**h.properties, "gather_stats": "true"}) if always else h


def _lacking(h: History, seen: Visible) -> list[str]:
    """Visible files that nothing has been gathered for."""
    if not seen.batches:
        return []
    listing = files.data_files(h.spark, [h.rows_path(b) for b in seen.batches]).select("file")
    dropped = h.dropped_files(seen, seen.batches)
    if dropped:
        listing = listing.where(~F.col("file").isin(dropped))
    kept = bounds.kept(h, seen.batches)
    if kept is not None:
        listing = listing.join(kept.select("file"), "file", "left_anti")
    return [r["file"] for r in listing.collect()]


def _history_facts(h: History, branch: str | None) -> DataFrame:
    """Facts of all visible files: gathered ones as they are kept, the others from a scan of just these files."""
    seen = h.visible(h.head(branch))
    lacking = _lacking(h, seen)
    parts = []
    kept = bounds.kept(h, seen.batches)
    if kept is not None:
        dropped = h.dropped_files(seen, seen.batches)
        parts.append(kept.where(~F.col("file").isin(dropped)) if dropped else kept)
    if lacking:
        spec_of = {b: h.commits[b].spec_id for b in {int(f.split("/")[1].removeprefix("batch=")) for f in lacking}}
        parts.append(bounds.scanned(h, spec_of, [files.file_name().isin(lacking)]))
    if not parts:
        nothing = h.live(None).withColumns({"_file": F.lit(""), "_path": F.lit(""), "_size": F.lit(0)})
        names = ["_added_in", "_row_id", *[f"_v{i}" for i in range(len(h.schema))], "_file", "_path", "_size"]
        return bounds.aggregated(nothing.toDF(*names), h.schema, names[2:-3])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def file_stats(source: DataFrame | History, columns: Sequence[str] | None = None, *,
               branch: str | None = None) -> DataFrame:
    """One row per (file, column): file facts, null count, lower and upper bound (as text).

    `source` is a file scan, possibly filtered, or a history: then all files of a branch head are listed, with
    the rows stored in them (removed ones too, until compaction). What `gather_stats` has kept is used as it is; only
    files without are scanned. Bounds of columns without an order are NULL.
    """
    schema = source.schema
    fields = [f for f in schema if columns is None or f.name in columns]
    if isinstance(source, History):
        per_file = _history_facts(source, branch)
        tag_of = [field_id(f) for f in fields]
    else:
        values = [f"_v{i}" for i in range(len(fields))]
        scan = source.select(
            *[col(f.name).alias(v) for f, v in zip(fields, values)], F.lit("").alias("_file"), *bounds.file_columns()[1:])
        tag_of = list(range(1, len(fields) + 1))
        numbered = T.StructType([make_field(i, f.name, f.dataType) for i, f in zip(tag_of, fields)])
        per_file = bounds.aggregated(scan, numbered, values)
    per_file = per_file.withColumn("file_format", F.upper(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)))

    def bound(tag: str):
        return lambda i: (F.col(f"{tag}{tag_of[i]}") if bounds.ordered(fields[i].dataType) else F.lit(None)).cast("string")

    return unpivot(per_file, T.StructType(fields), {
        "null_count": lambda i: F.coalesce(F.col(f"n{tag_of[i]}"), F.col("record_count")),  # a column added later
        "lower_bound": bound("lo"),
        "upper_bound": bound("hi"),
    }, keep=_FILE)


def partition_stats(source: DataFrame | History, spec: Sequence[tuple[str, str]] | None = None, *,
                    branch: str | None = None) -> DataFrame:
    """Rows and files per partition; hours are shown as their start time.

    A file scan is grouped by the given spec. A history is grouped by the spec each of its files was written
    under, with that spec's id; columns another spec has are NULL.
    """
    if isinstance(source, History):
        parts = [
            _partition_stats(df, [(t, f.name) for t, f in source.spec(s)]).withColumn("spec_id", F.lit(s))
            for s, df in _by_spec(source, branch).items()
        ]
        if not parts:
            return source.spark.createDataFrame([], "record_count long, file_count long, spec_id int")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if spec is None:
        raise ValueError("a file scan needs the spec to group by")
    return _partition_stats(source.withColumn("file_path", F.col("_metadata.file_path")), spec)


def _partition_stats(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    names = [f"{name}_{transform}" if transform != "identity" else name
             for transform, name in check_spec(spec, df.schema)]
    derived = [f"_p{i}" for i in range(len(spec))]
    per_file = with_partitions(df, spec, derived).groupBy(*derived, "file_path").agg(F.count("*").alias("_n"))
    shown = [
        (hour_start(F.col(d)) if transform == "hour" else F.col(d)).alias(n)
        for d, n, (transform, _) in zip(derived, names, spec)
    ]
    return (
        per_file.groupBy(*derived).agg(F.sum("_n").alias("record_count"), F.count("*").alias("file_count"))
        .select(*shown, "record_count", "file_count")
    )
