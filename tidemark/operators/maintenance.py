"""Partition specs, range reads, compaction and snapshot expiry."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import files
from tidemark.plans.bounds import files_outside
from tidemark.plans.fields import col, field_id, find
from tidemark.plans.history import Commit, History, Visible
from tidemark.plans.partitioning import check_spec, derive
from tidemark.plans.removals import listed_in

DEFAULT_TARGET_BYTES = 512 * 1024 * 1024
# A file is left alone while its size is between these shares of the target.
SMALL_SHARE, LARGE_SHARE = 0.75, 1.8


# -- partition spec -------------------------------------------------------------------------------


def partition_spec(h: History) -> list[tuple[str, str]]:
    return [(t, f.name) for t, f in h.spec(h.spec_id)]


def set_partition_spec(h: History, spec: Sequence[tuple[str, str]]) -> History:
    """Lay out rows written from now on by `spec`. Rows written before stay where they are."""
    new = [(t, field_id(find(h.schema, n))) for t, n in check_spec(spec, h.schema)]
    if new in h.specs:
        return h.save(spec_id=h.specs.index(new))
    return h.save(specs=[*h.specs, new], spec_id=len(h.specs))


def add_partition_field(h: History, transform: str, name: str) -> History:
    return set_partition_spec(h, [*partition_spec(h), (transform, name)])


def drop_partition_field(h: History, transform: str, name: str) -> History:
    if (transform, name) not in partition_spec(h):
        raise ValueError(f"{transform}({name}) is not a partition field")
    return set_partition_spec(h, [p for p in partition_spec(h) if p != (transform, name)])


def read_range(h: History, column: str, low=None, high=None, *, snapshot_id: int | None = None,
               branch: str | None = None) -> DataFrame:
    """Rows with low <= column < high.

    Each spec's directories are pruned by what it derives from the column, and files whose gathered bounds
    (`gather_stats`) miss the range are not opened; files without bounds are read. `low` and `high` are literals of the
    column's type, or strings that cast to it; None leaves a side open.
    """
    target = find(h.schema, column)
    bounds = [
        (compare, F.lit(value).cast(target.dataType))
        for compare, value in ((operator.ge, low), (operator.lt, high)) if value is not None
    ]

    def prune(transform: str, f: T.StructField, part: Column) -> Column | None:
        if field_id(f) != field_id(target) or not _prunes(transform, f.dataType) or not bounds:
            return None
        kept = F.lit(True)
        for compare, value in bounds:
            # day and hour round down, so the last bucket may hold values below `high`
            edge = operator.le if compare is operator.lt else compare
            kept = kept & edge(part, derive(transform, value, f.dataType))
        return kept

    snapshot_id = h.head(branch) if snapshot_id is None else snapshot_id
    outside = files_outside(h, h.visible(snapshot_id), target, *bounds) if bounds else []
    df = h.live(snapshot_id, prune, [~files.file_name().isin(outside)] if outside else [])
    for compare, value in bounds:
        df = df.where(compare(col(column), value))
    return df.select(*[col(f.name) for f in h.schema])


def _prunes(transform: str, dtype: T.DataType) -> bool:
    # Directory names keep neither '' apart from NULL nor a time zone, so such identities are not used.
    return transform != "identity" or isinstance(dtype, (T.IntegerType, T.LongType, T.DateType))


def cluster_by(h: History, column: str | None) -> History:
    """Lay out rows written from now on in ranges of a column, so that few files overlap a range; None: as they come.

    Holds for unpartitioned specs; `compact` keeps to it. With `gather_stats`, range reads open only what overlaps.
    """
    fid = "" if column is None else str(field_id(find(h.schema, column)))
    return h.save(properties={**h.properties, "cluster.field_id": fid})


# -- compaction -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class CompactCounts:
    files_before: int
    files_after: int
    bytes_before: int
    batches_rewritten: int
    files_rewritten: int = 0


def compact(h: History, target_bytes: int | None = None, *, branch: str | None = None,
            at: datetime | None = None) -> tuple[History, CompactCounts]:
    """Rewrite files that hold removed rows, follow an old spec or are far from `target_bytes`; leave all others alone.

    Small files of one partition are packed into groups of about the target; a small file that shares its group with
    none stays. Rows keep their keys, so staged changes stay applicable. Without partitions input splits are merged in
    place and nothing is shuffled. The driver sees one line per file that is rewritten or small.
    """
    target_bytes = target_bytes or h.target_file_bytes or DEFAULT_TARGET_BYTES
    seen = h.visible(h.head(branch))
    hits = h.removals_of(seen)
    if not seen.batches:
        return h, CompactCounts(0, 0, 0, 0)
    listing = _files(h, seen)
    totals = {r["batch"]: r for r in listing.groupBy("batch").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")).collect()}
    before, size = (sum(r[n] for r in totals.values()) for n in ("files", "bytes"))
    chosen = _groups(_marked(h, seen, hits, listing, target_bytes).where("must OR small").collect(), target_bytes)
    if not chosen:
        return h, CompactCounts(before, before, size, 0)

    names: dict[int, list[str]] = {}
    for r in chosen:
        names.setdefault(r["batch"], []).append(r["file"])
    whole = [b for b, files_of in names.items() if len(files_of) == totals[b]["files"]]
    partial = {b: files_of for b, files_of in names.items() if b not in whole}
    h = h.writable()
    batch = h.next_snapshot_id
    rows = [h.rows_of(seen, hits, whole)] if whole else []
    if partial:
        listed = [f for files_of in partial.values() for f in files_of]
        rows.append(h.rows_of(seen, hits, partial, chosen=[files.file_name().isin(listed)]))
        h.spark.createDataFrame([(b, f) for b, files_of in partial.items() for f in files_of], "batch long, file string") \
            .coalesce(1).write.parquet(h.dropped_path(batch))
    rows = rows[0].union(rows[1]) if len(rows) > 1 else rows[0]
    size_chosen = sum(r["length"] for r in chosen)
    # Only files to be cut need their rows counted first; others are merged to about the target, not cut to it.
    cut = any(r["length"] > target_bytes * LARGE_SHARE for r in chosen)
    wanted = max(1, -(-size_chosen // target_bytes) if cut else round(size_chosen / target_bytes))
    h.write_rows(batch, rows, keep_keys=F.lit(True), files_wanted=wanted, rows_total=rows.count() if cut else None,
                 target_bytes=target_bytes)
    new_files, _ = files.size_of(h.spark, [h.rows_path(batch, h.spec_id)])
    kept = h.written(batch).count()
    new = h.commit("replace", snapshot_id=batch, spec_id=h.spec_id, has_rows=kept > 0, supersedes=sorted(whole),
                   dropped={b: len(f) for b, f in partial.items()}, folded=seen.removals, branch=branch, at=at,
                   origins=sorted({o for b in names for o in h.commits[b].origins}))
    return new, CompactCounts(before, before - len(chosen) + new_files, size, len(names), len(chosen))


def _files(h: History, seen: Visible) -> DataFrame:
    """(batch, file, folder, length) of every visible file."""
    listing = files.data_files(h.spark, [h.rows_path(b) for b in seen.batches]).select(
        F.regexp_extract("file", r"^spec=\d+/batch=(\d+)/", 1).cast("long").alias("batch"), "file",
        F.regexp_extract("file", r"^spec=\d+/batch=\d+/attempt=[^/]*/(.*/)?", 1).alias("folder"), "length")
    gone = h.dropped_files(seen, seen.batches)
    if gone:
        listing = listing.where(~F.col("file").isin(gone))
    return listing


def _marked(h: History, seen: Visible, hits: dict[int, list[int]], listing: DataFrame, target_bytes: int) -> DataFrame:
    """Adds must (the file is to be rewritten in any case) and small."""
    dirty = _dirty_files(h, seen, hits)
    other_spec = [b for b in seen.batches if h.commits[b].spec_id != h.spec_id]
    must = F.col("batch").isin(other_spec) | (F.col("length") > target_bytes * LARGE_SHARE)
    if dirty is not None:
        listing = listing.join(F.broadcast(dirty.withColumn("dirty", F.lit(True))), "file", "left")  # a name a file
        must = must | F.col("dirty").isNotNull()
    return listing.select("batch", "file", "folder", "length", must.alias("must"),
                          (F.col("length") < target_bytes * SMALL_SHARE).alias("small"))


def _dirty_files(h: History, seen: Visible, hits: dict[int, list[int]]) -> DataFrame | None:
    """Files that hold removed rows, found from row keys alone."""
    by_spec: dict[int, list[int]] = {}
    for b in seen.batches:
        if hits[b]:
            by_spec.setdefault(h.commits[b].spec_id, []).append(b)
    out = None
    for spec_id, members in sorted(by_spec.items()):
        rows = h.scan(spec_id, members, extra=[files.file_name().alias("_file")], chosen=h.visible_files(seen, members))
        words = h.removals_to_join({r for b in members for r in hits[b]})
        found = listed_in(rows.select("_added_in", "_row_id", "_file"), words).select(F.col("_file").alias("file")).distinct()
        out = found if out is None else out.union(found)
    return out


def _groups(candidates: list, target_bytes: int) -> list:
    """The files to rewrite: all that must be, and small ones that share a group with another file.

    Groups are filled smallest files first, partition by partition, up to the target.
    """
    chosen = [r for r in candidates if r["must"]]
    by_folder: dict[str, list] = {}
    for r in candidates:
        if not r["must"]:
            by_folder.setdefault(r["folder"], []).append(r)
    # What must be rewritten anyway takes in small neighbours as far as there is room.
    room: dict[str, int] = {}
    for r in chosen:
        room[r["folder"]] = room.get(r["folder"], 0) + r["length"]
    for folder, small in sorted(by_folder.items()):
        group, held = [], room.get(folder, 0) % target_bytes
        joined = held > 0
        for r in sorted(small, key=lambda r: (r["length"], r["file"])):
            if held + r["length"] > target_bytes and (group or joined):
                chosen += group if joined or len(group) > 1 else []
                group, held, joined = [], 0, False
            group.append(r)
            held += r["length"]
        chosen += group if joined or len(group) > 1 else []
    return chosen


# -- expiry ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ExpireCounts:
    expired_snapshots: int
    deleted_batches: int
    deleted_removals: int


def expire(h: History, older_than: datetime, retain_last: int = 1) -> tuple[History, ExpireCounts]:
    """Expire snapshots committed before `older_than` and delete the data none of the others shows.

    Every branch keeps its head and the last `retain_last` of its snapshots. Staged snapshots that no
    branch holds go by age alone. Rows a delete has hidden leave storage once `compact` has rewritten
    their batch and the snapshots before it have expired.
    """
    if retain_last < 1:
        raise ValueError("retain_last must be at least 1")
    older_than = older_than if older_than.tzinfo else older_than.replace(tzinfo=timezone.utc)
    alive = {s: c for s, c in h.commits.items() if not c.expired}
    keep = {s for s, c in alive.items() if datetime.fromisoformat(c.committed_at) >= older_than}
    for head in h.refs.values():
        keep.update([s for s in h.lineage(head) if s in alive][-retain_last:])
    rows, removals, taken = _needed(h, keep)

    changed: dict[int, Commit] = {s: replace(c, expired=True) for s, c in alive.items() if s not in keep}
    old_rows = [s for s, c in h.commits.items() if c.has_rows and not c.rows_gone and s not in rows]
    old_removals = [s for s, c in h.commits.items() if c.removed and not c.removals_gone and s not in removals]
    for s in old_rows:
        changed[s] = replace(changed.get(s, h.commits[s]), rows_gone=True)
    for s in old_removals:
        changed[s] = replace(changed.get(s, h.commits[s]), removals_gone=True)
    # The log goes first: if this stops half way, files are left over but no snapshot misses any.
    new = h.save(list(changed.values())) if changed else h
    for s in old_rows:
        files.delete(h.spark, h.rows_path(s))
    for s in old_removals:
        files.delete(h.spark, h.removals_path(s))
    for b, compactions in taken.items():
        if compactions:
            seen = Visible([b], [], {b: sorted(compactions)})
            files.delete_encoded(h.spark, f"{h.path}/rows", h.dropped_files(seen, [b]))
    return new, ExpireCounts(len(alive) - len(keep), len(old_rows), len(old_removals))


def _needed(h: History, keep: set[int]) -> tuple[set[int], set[int], dict[int, set[int]]]:
    """Batches and removals that some kept snapshot reads; by batch, the compactions that took files from all of them."""
    rows: set[int] = set()
    removals: set[int] = set()
    taken: dict[int, set[int]] = {}
    for s in keep:
        seen = h.visible(s)
        rows.update(seen.batches)
        for b in seen.batches:
            here = set(seen.partial.get(b, ()))
            taken[b] = taken[b] & here if b in taken else here
        for hits in h.removals_of(seen).values():
            removals.update(hits)
    return rows, removals, taken


def stored_rows(h: History) -> DataFrame:
    """Every row still in storage with its row key, whether a snapshot shows it or not."""
    batches = [s for s, c in h.commits.items() if c.has_rows and not c.rows_gone]
    return h.rows_of(Visible(batches, []), {})
