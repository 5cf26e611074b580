"""Creating a history and adding rows to it."""

from __future__ import annotations

import json
import operator
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import files, names
from tidemark.plans.fields import can_store, check_incoming, col, field_id, find, number_fields
from tidemark.plans.history import History
from tidemark.plans.partitioning import check_spec


def _new_history(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str] | None,
                 spec: Sequence[tuple[str, str]], properties: dict[str, str] | None) -> History:
    if names.is_name(path):
        if names.taken(spark, path):
            raise ValueError(f"a table named {path} exists already")
        name, path = names.full_name(spark, path), names.new_location(spark, path)
        properties = names.with_name(dict(properties or {}), name, "main")
    path = path.rstrip("/")
    if files.exists(spark, f"{path}/log"):
        raise ValueError(f"a history exists already at {path}")
    for name in key or ():
        find(schema, name)
    return History(
        spark=spark,
        path=path,
        version=0,
        schema=schema,
        next_field_id=len(schema) + 1,
        specs=[[(t, field_id(find(schema, n))) for t, n in check_spec(spec, schema)]],
        spec_id=0,
        key=list(key or ()),
        properties=dict(properties or {}),
        commits={},
        refs={"main": None},
        ref_log=[],
    )


def create_history(df: DataFrame, path: str, key: Sequence[str] | None = None, *,
                   spec: Sequence[tuple[str, str]] = (), properties: dict[str, str] | None = None,
                   at: datetime | None = None) -> History:
    """Create a history from a DataFrame and load it in its first snapshot. Fails if one exists.

    `path` is a folder, or a name in the session catalog (`table` or `namespace.table`): then the history lives in a
    folder of the namespace, and the name shows the head of main after every commit.
    """
    schema = number_fields(df.schema, keep_required=False)
    return append(_new_history(df.sparkSession, path, schema, key, spec, properties), df, at=at)


def ensure_history(spark: SparkSession, path: str, schema: T.StructType | str,
                   spec: Sequence[tuple[str, str]] = (), key: Sequence[str] | None = None,
                   properties: dict[str, str] | None = None) -> History:
    """Open the history at a path or of a name, or create an empty one with an explicit schema."""
    there = names.taken(spark, path) if names.is_name(path) else files.exists(spark, f"{path.rstrip('/')}/log")
    if there:
        return load_history(spark, path)
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return _new_history(spark, path, number_fields(schema), key, spec, properties).save()


def load_history(spark: SparkSession, path: str) -> History:
    """The history at a path or of a name. Opened by the name of a branch's view, that branch is its default."""
    if not names.is_name(path):
        return History.load(spark, path.rstrip("/"))
    location = names.location_of(spark, path)
    if location is None:
        raise ValueError(f"no history named {path}")
    h = History.load(spark, location)
    branch = names.names_of(h.properties).get(names.full_name(spark, path), "main")
    return replace(h, branch=branch) if branch in h.refs else h


def attach_history(h: History, name: str, branch: str | None = None) -> History:
    """Give a branch of a history a name in the session catalog, which shows its head after every commit."""
    branch, name = branch or h.branch, names.full_name(h.spark, name)
    h.head(branch)
    if names.taken(h.spark, name):
        raise ValueError(f"a table named {name} exists already")
    return h.save(properties=names.with_name(h.properties, name, branch))


def detach_history(h: History, name: str) -> History:
    """Take a name from a history; its data stays where it is."""
    name = names.full_name(h.spark, name)
    left = {n: b for n, b in names.names_of(h.properties).items() if n != name}
    return h.save(properties={**h.properties, names.NAMES: json.dumps(left, sort_keys=True)})


def refresh_names(h: History) -> None:
    """Bring the views of a history's names up to its head, should a writer have died before it could."""
    names.publish(h)


def append(h: History, df: DataFrame, *, branch: str | None = None, wap_id: str | None = None,
           at: datetime | None = None, summary: dict[str, str] | None = None) -> History:
    """Append rows, matching columns by name. Nullable columns the input lacks become NULL."""
    h = h.writable(wap_id)
    check_incoming(h.schema, df)
    h.head(branch)
    batch = h.next_snapshot_id
    h.write_rows(batch, df)
    added = h.written(batch).count()
    return h.commit("append", snapshot_id=batch, added_rows=added, spec_id=h.spec_id, has_rows=added > 0,
                    origins=[batch], branch=branch, wap_id=wap_id, at=at, summary=summary)


def insert_positional(h: History, df: DataFrame, **options) -> History:
    """Append rows, matching columns by position. The column count and types must fit."""
    if len(df.columns) != len(h.schema):
        raise ValueError(f"{len(df.columns)} columns given, the table has {len(h.schema)}")
    for src, dst in zip(df.schema, h.schema):
        if not can_store(src.dataType, dst.dataType):
            raise ValueError(f"cannot write {src.dataType.simpleString()} to {dst.name} "
                             f"{dst.dataType.simpleString()}")
    return append(h, df.toDF(*h.schema.names), **options)


def overwrite(h: History, df: DataFrame, *, branch: str | None = None, wap_id: str | None = None,
              at: datetime | None = None, summary: dict[str, str] | None = None) -> History:
    """Replace all rows. The old ones stay readable at earlier snapshots and none is listed one by one."""
    h = h.writable(wap_id)
    check_incoming(h.schema, df)
    head = h.head(branch)
    batch = h.next_snapshot_id
    h.write_rows(batch, df)
    added = h.written(batch).count()
    before = h.total_rows(head)
    seen = h.visible(head)
    return h.commit("overwrite", snapshot_id=batch, added_rows=added, removed_rows=before, spec_id=h.spec_id,
                    has_rows=added > 0, origins=[batch], supersedes=seen.batches, folded=seen.removals,
                    branch=branch, wap_id=wap_id, at=at, summary=summary)


def append_files(h: History, paths: str | Sequence[str], **options) -> History:
    """Append the rows of Parquet files that are already written."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return append(h, h.spark.read.parquet(*paths), **options)


def add_derived(h: History, name: str, expr, **options) -> History:
    """Compute a column from the whole table, add it to the schema and write every row back."""
    from tidemark.operators.evolve import union_schema
    from tidemark.operators.snapshots import read_at

    value = F.expr(expr) if isinstance(expr, str) else expr
    df = read_at(h, branch=options.get("branch")).withColumn(name, value)
    return overwrite(union_schema(h, df.schema), df, **options)


#: Buckets that rows are fingerprinted in; what is compared first has that many rows a side.
RECONCILE_BUCKETS = 4096


def reconcile(src: DataFrame, df: DataFrame) -> DataFrame:
    """Compare two sets of rows, duplicates counted: one row with both sizes and the differences.

    Each side is first reduced to a row count and four sums of two 64-bit row hashes per bucket, which do not depend on
    the order of rows. Only rows of buckets that differ are then shuffled and compared exactly; where none does, adaptive
    execution skips that part. Sets with equal fingerprints count as equal: 128 bits of sums a bucket stand against
    chance. Columns are compared by name, NULL equal to NULL; maps by their entries.
    """
    names = src.columns
    given = [side.select(*[col(n) for n in names]) for side in (src, df)]
    common = given[0].union(given[1]).schema  # types that hold both sides' values
    sides = [
        side.select(*[_comparable(col(f.name).cast(f.dataType), f.dataType).alias(f"c{i}") for i, f in enumerate(common)])
        for side in given
    ]
    hashed = [_with_hashes(side) for side in sides]
    # one text a bucket, so that both uses below read the same columns and share one scan of each side
    source, written = (
        h.groupBy("bucket").agg(F.concat_ws(":", F.count("*"), *[
            F.sum(part) for part in _halves("h1") + _halves("h2")]).alias(name))
        for h, name in zip(hashed, ("source", "written"))
    )
    both = source.join(written, "bucket", "full_outer")
    differ = F.broadcast(both.where(~F.col("source").eqNullSafe(F.col("written"))).select("bucket"))  # bounded
    rows_in = lambda c: F.coalesce(F.sum(F.element_at(F.split(c, ":"), 1).cast("long")), F.lit(0).cast("long"))
    sizes = both.agg(rows_in("source").alias("source_rows"), rows_in("written").alias("written_rows"))
    values = [f"c{i}" for i in range(len(names))]
    tagged = [
        h.join(differ, "bucket", "left_semi").select(*values, F.lit(sign).cast("long").alias("side"))
        for h, sign in zip(hashed, (1, -1))
    ]
    balance = tagged[0].union(tagged[1]).groupBy(*values).agg(F.sum("side").alias("balance"))
    zero = F.lit(0).cast("long")
    found = balance.agg(
        F.coalesce(F.sum(F.greatest("balance", zero)), zero).alias("missing_rows"),
        F.coalesce(F.sum(F.greatest(-F.col("balance"), zero)), zero).alias("unexpected_rows"))
    return sizes.crossJoin(F.broadcast(found))  # one row each


def _comparable(value: Column, dtype: T.DataType) -> Column:
    """A value that can be hashed and compared with nothing lost; floating-point zeros are one value."""
    if isinstance(dtype, T.MapType):
        return _as_text(F.array_sort(F.map_entries(value)))
    if isinstance(dtype, (T.ArrayType, T.StructType, T.VariantType)):
        return _as_text(value)
    return value + F.lit(0.0).cast(dtype) if isinstance(dtype, (T.FloatType, T.DoubleType)) else value


def _as_text(c: Column) -> Column:
    """Nested values as JSON: hashes of nested values pass over nulls, JSON does not."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), options))


def _with_hashes(side: DataFrame) -> DataFrame:
    """Rows with two independent hashes of all columns, nulls included, and the bucket they fall in."""
    # a hash passes over nulls, so say where they are: one bit a column, 62 columns a number
    flags = []
    for i in range(0, len(side.columns), 62):
        bits = [F.col(c).isNull().cast("long") * F.lit(1 << k) for k, c in enumerate(side.columns[i : i + 62])]
        flags.append(reduce(operator.add, bits))
    parts = [*flags, *[F.col(c) for c in side.columns]]
    h1, h2 = F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)
    out = side.select("*", h1.alias("h1"), h2.alias("h2"))
    return out.withColumn("bucket", F.pmod(F.col("h1"), F.lit(RECONCILE_BUCKETS)))


def _halves(name: str) -> list[Column]:
    """The two halves of a 64-bit hash; sums of them do not overflow."""
    return [F.col(name).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(name, 32)]
