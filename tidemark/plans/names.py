"""Histories by name: session-catalog views that carry a history's location and show a branch head.

A history keeps the names it goes by, each with its branch, among its properties. Whenever a commit moves that branch or
changes the schema, the view of that name is replaced by one over the files the head is made of, in one catalog
operation: ``spark.table(name)``, SQL and views on top of it then show the commit in every session that shares
the catalog. The files stand in the view as external tables with an explicit schema, in a database of their own, named
by log version; those of the version before stay until the next commit, for readers that hold the older plan.

The log is what counts: if a writer dies between the log and the view, the view is behind until the next commit or
`refresh_names`. A session whose catalog lacks the name, or has another table there, leaves its catalog alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidemark.plans import removals as gone
from tidemark.plans.fields import stored_name
from tidemark.sources.views import quoted, text_literal

LOCATION, BRANCH, VERSION = "tidemark.location", "tidemark.branch", "tidemark.version"
#: Property of a history: its names as JSON, each with the branch it shows.
NAMES = "catalog.names"
FILES_DATABASE = "tidemark_files"

_NAME = re.compile(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", re.ASCII)


def is_name(target: str) -> bool:
    """`table` or `namespace.table`; anything else is a path."""
    return bool(_NAME.fullmatch(target))


def full_name(spark: SparkSession, name: str) -> str:
    return (name if "." in name else f"{spark.catalog.currentDatabase()}.{name}").lower()


def taken(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(full_name(spark, name))


def location_of(spark: SparkSession, name: str) -> str | None:
    """Where the history of this name lives; None if there is no such table or it is not a history."""
    if not taken(spark, name):
        return None
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(full_name(spark, name))}").collect()
    return {r["key"]: r["value"] for r in rows}.get(LOCATION)


def new_location(spark: SparkSession, name: str) -> str:
    """A fresh folder below the namespace's own location."""
    namespace, table = full_name(spark, name).split(".")
    base = spark.catalog.getDatabase(namespace).locationUri.rstrip("/")
    return f"{base}/{table}.history-{uuid.uuid4().hex}"


def names_of(properties: dict[str, str]) -> dict[str, str]:
    return json.loads(properties.get(NAMES, "{}"))


def with_name(properties: dict[str, str], name: str, branch: str) -> dict[str, str]:
    return {**properties, NAMES: json.dumps({**names_of(properties), name: branch}, sort_keys=True)}


def publish(new, old=None) -> None:
    """Bring the views of a history's names up to what `new` is; with `old`, only those that changed since."""
    before = names_of(old.properties) if old is not None and old.version else {}
    now = names_of(new.properties)
    for name in before.keys() - now.keys():
        _drop(new, name)
    for name, branch in now.items():
        created = name not in before
        if old is not None and not created and new.refs.get(branch) == old.refs.get(branch) and new.schema == old.schema:
            continue
        here = location_of(new.spark, name)
        if branch not in new.refs:
            _drop(new, name)
        elif here == new.path or (created and not taken(new.spark, name)):
            _replace(new, name, branch)


def _tables_like(name: str) -> str:
    return "h" + hashlib.sha256(name.encode()).hexdigest()[:20]


def _drop(h, name: str) -> None:
    if location_of(h.spark, name) == h.path:
        h.spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")
        _drop_tables(h.spark, name, h.version + 1)


def _drop_tables(spark: SparkSession, name: str, before: int) -> None:
    """Forget the file tables of versions before this one; no file is touched."""
    if not spark.catalog.databaseExists(FILES_DATABASE):
        return
    prefix = _tables_like(name)
    for r in spark.sql(f"SHOW TABLES IN {FILES_DATABASE} LIKE '{prefix}_*'").collect():
        if int(r["tableName"].split("_")[1]) < before:
            spark.sql(f"DROP TABLE IF EXISTS {FILES_DATABASE}.{quoted(r['tableName'])}")


def _replace(h, name: str, branch: str) -> None:
    spark = h.spark
    rows = spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect() if taken(spark, name) else []
    shown = int({r["key"]: r["value"] for r in rows}.get(VERSION, "0"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {FILES_DATABASE}")
    prefix = f"{FILES_DATABASE}.{_tables_like(name)}_{h.version}_{uuid.uuid4().hex[:8]}"
    query = _query(h, branch, prefix)
    columns = ", ".join(
        quoted(f.name, whole=True) + (f" COMMENT {text_literal(f.metadata['comment'])}" if "comment" in f.metadata else "")
        for f in h.schema)
    properties = ", ".join(
        f"{text_literal(k)} = {text_literal(v)}"
        for k, v in ((LOCATION, h.path), (BRANCH, branch), (VERSION, str(h.version))))
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(name)} ({columns}) TBLPROPERTIES ({properties}) AS {query}")
    _drop_tables(spark, name, shown)


def _query(h, branch: str, prefix: str) -> str:
    """SQL over the files a branch head is made of; makes the tables it reads."""
    seen = h.visible(h.head(branch))
    hits = h.removals_of(seen)
    values = ", ".join(f"{stored_name(f)} AS {quoted(f.name, whole=True)}" for f in h.schema)
    groups: dict[tuple[int, bool], list[int]] = {}
    for b in seen.batches:
        groups.setdefault((h.commits[b].spec_id, bool(hits[b])), []).append(b)
    parts = []
    for i, ((spec_id, dirty), members) in enumerate(sorted(groups.items())):
        table = f"{prefix}_{i}"
        folders = [h.rows_path(b).removeprefix(f"{h.path}/rows/spec={spec_id}/") for b in members]
        _file_table(h.spark, table, h.stored_schema(spec_id), f"{h.path}/rows/spec={spec_id}", folders)
        join = hint = ""
        if dirty:
            ids = sorted({r for b in members for r in hits[b]})
            folders = [h.removals_path(r).removeprefix(f"{h.path}/removals/") for r in ids]
            _file_table(h.spark, f"{table}_gone", gone.SCHEMA, f"{h.path}/removals", folders)
            join = f" LEFT ANTI JOIN {table}_gone AS g ON {gone.HIT_SQL}"
            hint = "/*+ BROADCAST(g) */ " if h.few_removals(ids) else ""
        dropped = h.dropped_files(seen, members)
        kept = f" WHERE NOT {_FILE_SQL} IN ({', '.join(map(text_literal, dropped))})" if dropped else ""
        parts.append(f"SELECT {hint}{values} FROM (SELECT * FROM {table}{kept}) AS r{join}")
    if not parts:
        nulls = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {quoted(f.name, whole=True)}" for f in h.schema)
        return f"SELECT {nulls} WHERE false"
    return " UNION ALL ".join(parts)


_FILE_SQL = r"regexp_extract(_metadata.file_path, '/rows/(spec=\\d+/batch=\\d+/attempt=.*)$', 1)"


def _file_table(spark: SparkSession, name: str, schema: T.StructType, root: str, folders: list[str]) -> None:
    """An external table of the files in some folders below `root`, with an explicit schema."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    schema = schema.add("batch", T.LongType()).add("attempt", T.StringType())
    spark.catalog.createTable(
        name, source="parquet", schema=schema, path=f"{root}/{{{','.join(folders)}}}", basePath=root)
