"""Row-level changes: update, delete and upsert.

Each change scans the table once and lists the keys of the rows it removes, few or many. Reads leave those rows out;
compaction takes them out of the files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.fields import check_incoming, col, field_id, find, stored_name
from tidemark.plans.history import ROW_KEY, History, Prune, Visible
from tidemark.plans.partitioning import check_spec, derive

MAX_BROADCAST_KEYS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: Slots of the bit filter of a larger source's keys, in words of 64: a million broadcast rows at most. Beyond so many keys
#: half of all rows would pass, and the filter is left out.
FILTER_WORDS, MAX_FILTER_KEYS = 1 << 20, 40_000_000

_PREVIOUS = T.StructType([T.StructField("_prev_in", T.LongType()), T.StructField("_prev_id", T.LongType())])


def _condition(cond: Column | str) -> Column:
    return F.expr(cond) if isinstance(cond, str) else cond


def _require_deterministic(df: DataFrame, what: str) -> None:
    if not df._jdf.queryExecution().analyzed().deterministic():
        raise ValueError(f"{what} must give the same result each time it is evaluated")


@dataclass
class _Target:
    """The rows of a branch that a change works on."""

    h: History
    branch: str | None

    def __post_init__(self):
        self.head = self.h.head(self.branch)
        self.seen = self.h.visible(self.head)
        self.hits = self.h.removals_of(self.seen)

    def live(self) -> DataFrame:
        return self.h.rows_of(self.seen, self.hits)

    def emptied(self, removed: dict[int, int]) -> list[int]:
        """Batches none of whose rows are left, as far as the log alone can tell; reads need not open them."""
        if sum(removed.values()) == self.h.total_rows(self.head):
            return self.seen.batches
        return [
            b for b in self.seen.batches if not self.hits[b] and b not in self.seen.partial
            and self.h.commits[b].origins == [b] and removed.get(b) == self.h.commits[b].added_rows
        ]


def delete_where(h: History, cond: Column | str, *, branch: str | None = None, wap_id: str | None = None,
                 at: datetime | None = None, summary: dict[str, str] | None = None) -> History:
    """Delete the rows for which `cond` is true; rows for which it is NULL stay.

    One scan writes the keys of the rows that go; counts are read back from that small output.
    """
    h = h.writable(wap_id)
    target, batch = _Target(h, branch), h.next_snapshot_id
    matching = target.live().where(_condition(cond))
    _require_deterministic(matching, "a delete condition")
    h.write_removals(batch, matching)
    listed = h.listed(batch)
    removed = listed["removed"]
    return h.commit("delete", snapshot_id=batch, removed_rows=sum(removed.values()), spec_id=h.spec_id, branch=branch,
                    wap_id=wap_id, at=at, summary=summary, supersedes=target.emptied(removed), **listed)


def delete_partition(h: History, transform: str, column: str, value, *, branch: str | None = None,
                     wap_id: str | None = None, at: datetime | None = None,
                     summary: dict[str, str] | None = None) -> History:
    """Delete the rows of one partition value, such as ("day", "ts", "2024-01-05") or ("identity", "level", "error").

    Files written under a spec with that transform are dropped by name: no row of them is read, unless earlier removals
    hit their batch and live rows must be counted. Rows of other specs are listed by key as `delete_where` does. `value`
    is a value of the derived column's type or a string that casts to it (hours: a timestamp); None means NULL.
    """
    h = h.writable(wap_id)
    target, batch = _Target(h, branch), h.next_snapshot_id
    field = find(h.schema, column)
    check_spec([(transform, column)], h.schema)
    literal = F.lit(value).cast(field.dataType if transform != "day" else T.DateType())
    wanted = derive(transform, literal, field.dataType) if transform == "hour" else literal
    here = [b for b in target.seen.batches if _names_files(h, b, transform, field)]
    by_key = [b for b in target.seen.batches if b not in here]

    def in_partition(t: str, f: T.StructField, part: Column) -> Column | None:
        return part.eqNullSafe(wanted) if (t, field_id(f)) == (transform, field_id(field)) else None

    names, dropped, gone_rows = [], {}, 0
    if here:
        for spec_id in sorted({h.commits[b].spec_id for b in here}):
            members = [b for b in here if h.commits[b].spec_id == spec_id]
            names += _files_in(h, target.seen, spec_id, members, in_partition)
        for f in names:
            b = int(f.split("/")[1].removeprefix("batch="))
            dropped[b] = dropped.get(b, 0) + 1
        if names:
            gone_rows = h.rows_of(target.seen, target.hits, sorted(dropped), in_partition).count()
    listed = {}
    if by_key:
        rows = h.rows_of(target.seen, target.hits, by_key)
        h.write_removals(batch, rows.where(derive(transform, col(column), field.dataType).eqNullSafe(wanted)))
        listed = h.listed(batch)
        gone_rows += sum(listed["removed"].values())
    if names:
        h.spark.createDataFrame([(int(f.split("/")[1].removeprefix("batch=")), f) for f in names], "batch long, file string") \
            .coalesce(1).write.parquet(h.dropped_path(batch))
    return h.commit("delete", snapshot_id=batch, removed_rows=gone_rows, spec_id=h.spec_id, branch=branch, wap_id=wap_id,
                    at=at, summary=summary, dropped=dropped, **listed)


def _names_files(h: History, batch: int, transform: str, field: T.StructField) -> bool:
    """Do the folders of a batch tell the partition value apart? Folder names keep '' and NULL as one."""
    spec = [(t, field_id(f)) for t, f in h.spec(h.commits[batch].spec_id)]
    return (transform, field_id(field)) in spec and not (transform == "identity" and isinstance(field.dataType, T.StringType))


def _files_in(h: History, seen: Visible, spec_id: int, batches: list[int], prune: Prune) -> list[str]:
    """Visible files of some batches that lie in a partition, from the listing alone."""
    listing = h.partition_listing(spec_id, batches, prune)
    dropped = h.dropped_files(seen, batches)
    if dropped:
        listing = listing.where(~F.col("file").isin(dropped))
    return [r["file"] for r in listing.collect()]


def update_where(h: History, set: dict[str, Column | str], where: Column | str | None = None, *,
                 branch: str | None = None, wap_id: str | None = None, at: datetime | None = None,
                 summary: dict[str, str] | None = None) -> History:
    """Assign expressions over the old row to columns of every matching row.

    One scan writes the new rows beside the keys of the old ones; the keys are listed from that output.
    """
    h = h.writable(wap_id)
    for name in set:
        find(h.schema, name)
    new_values = {n: _condition(e) for n, e in set.items()}
    target, batch = _Target(h, branch), h.next_snapshot_id
    live = target.live()
    options = {"spec_id": h.spec_id, "branch": branch, "wap_id": wap_id, "at": at, "summary": summary}
    if where is None:
        # Every row changes: one pass writes the new version of all batches, and no key needs listing.
        h.write_rows(batch, _assign(live, new_values))
        changed = h.written(batch).count()
        return h.commit("overwrite", snapshot_id=batch, added_rows=changed, removed_rows=changed, has_rows=changed > 0,
                        supersedes=target.seen.batches, origins=[batch], folded=target.seen.removals, **options)
    matching = live.where(_condition(where))
    _require_deterministic(matching, "an update condition")
    old = [F.col(n).alias(p) for n, p in zip(ROW_KEY, _PREVIOUS.names)]
    h.write_rows(batch, _assign(matching.select("*", *old), new_values), extra=_PREVIOUS.names)
    listed = _list_replaced(h, batch, h.written(batch, _PREVIOUS))
    changed = sum(listed["removed"].values())
    return h.commit("overwrite", snapshot_id=batch, added_rows=changed, removed_rows=changed, has_rows=changed > 0,
                    origins=[batch], supersedes=target.emptied(listed["removed"]), **listed, **options)


def _list_replaced(h: History, batch: int, written: DataFrame) -> dict:
    """List the keys of the rows that a batch just written replaces."""
    replaced = written.where(F.col("_prev_in").isNotNull()).select(
        F.col("_prev_in").alias("_added_in"), F.col("_prev_id").alias("_row_id"))
    h.write_removals(batch, replaced)
    return h.listed(batch)


def _assign(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Set columns in one projection, so that each expression sees the old row."""
    return df.select(*[
        values[n].cast(df.schema[n].dataType).alias(n) if n in values else col(n) for n in df.columns
    ])


@dataclass(frozen=True)
class UpsertCounts:
    inserted: int
    updated: int
    unchanged: int


def upsert(h: History, src: DataFrame, key: Sequence[str] | None = None, *, branch: str | None = None,
           wap_id: str | None = None, at: datetime | None = None,
           summary: dict[str, str] | None = None) -> tuple[History, UpsertCounts]:
    """Insert source rows with new keys, update those that differ, skip identical ones.

    Source keys must be unique and not NULL. An upsert that changes nothing makes no snapshot.
    """
    before, h = h, h.writable(wap_id)
    check_incoming(h.schema, src)
    key = list(key or h.key)
    if not key:
        raise ValueError("an upsert needs a key: declare one on the history or pass key=")
    missing = [n for n in key if n not in src.columns]
    if missing:
        raise ValueError(f"key columns {missing} are not in the source")
    _require_deterministic(src, "an upsert source")
    total, key_bytes = _check_keys(src, key)
    target, batch = _Target(h, branch), h.next_snapshot_id

    few, filtered = _fits(total, key_bytes), total <= MAX_FILTER_KEYS
    h.write_rows(batch, _classified(target.live(), src, key, h.schema, few, filtered), extra=_PREVIOUS.names)
    stored_key = [T.StructField(stored_name(f), f.dataType) for f in (find(h.schema, n) for n in key)]
    written = h.written(batch, T.StructType(_PREVIOUS.fields + stored_key))
    listed = _list_replaced(h, batch, written)
    updated, added = sum(listed["removed"].values()), _count_written(written, [f.name for f in stored_key])
    counts = UpsertCounts(inserted=added - updated, updated=updated, unchanged=total - added)
    if not added:
        return before, counts
    new = h.commit("overwrite" if updated else "append", snapshot_id=batch, added_rows=added, removed_rows=updated,
                   spec_id=h.spec_id, branch=branch, wap_id=wap_id, at=at, summary=summary, has_rows=True,
                   origins=[batch], supersedes=target.emptied(listed["removed"]), **listed)
    return new, counts


def _check_keys(src: DataFrame, key: list[str]) -> tuple[int, int]:
    """(rows, bytes of their keys) of the source; raises on a repeated or NULL key."""
    no_key, width = F.lit(False), F.lit(0)
    for n in key:
        no_key = no_key | col(n).isNull()
        width = width + F.coalesce(F.octet_length(col(n).cast("string")), F.lit(0))
    row = (
        src.groupBy(*[col(n) for n in key]).agg(F.count("*").alias("_n"))
        .agg(F.sum("_n").alias("total"), F.max("_n").alias("most"), F.count_if(no_key).alias("nulls"),
             F.sum(width).alias("bytes"))
        .first()
    )
    if row["nulls"]:
        raise ValueError("the source has rows with a NULL key")
    if (row["most"] or 0) > 1:
        raise ValueError("the source has more than one row for a key")
    return row["total"] or 0, row["bytes"] or 0


def _fits(rows: int, key_bytes: int) -> bool:
    """Are a source's keys, as counted, small enough to broadcast?"""
    return rows <= MAX_BROADCAST_KEYS and key_bytes <= MAX_BROADCAST_BYTES


def _count_written(written: DataFrame, key: list[str]) -> int:
    """Rows to insert or update; raises if a source row would replace several rows of the table."""
    row = written.groupBy(*key).agg(F.count("*").alias("_n")).agg(
        F.sum("_n").alias("total"), F.max("_n").alias("most")
    ).first()
    if (row["most"] or 0) > 1:
        raise ValueError("the table has more than one row for a key")
    return row["total"] or 0


def _key_filter(keys: DataFrame) -> DataFrame:
    """One slot bit for each key, in words: (_slot_word, _slot_mask), FILTER_WORDS rows at most."""
    slot = F.pmod(F.xxhash64(*[col(n) for n in keys.columns]), F.lit(FILTER_WORDS * 64))
    slots = keys.select(F.shiftright(slot, 6).alias("_slot_word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("_slot_bit"))
    return slots.groupBy("_slot_word").agg(F.expr("bit_or(shiftleft(1L, _slot_bit))").alias("_slot_mask"))


def _may_match(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key may be among `keys`: all that are, few others. The broadcast is bounded and nothing is shuffled."""
    slot = F.pmod(F.xxhash64(*[col(n) for n in keys.columns]), F.lit(FILTER_WORDS * 64))
    bit = F.getbit("_slot_mask", slot.bitwiseAND(F.lit(63)).cast("int"))
    return rows.join(
        F.broadcast(_key_filter(keys)), (F.shiftright(slot, 6) == F.col("_slot_word")) & (bit == 1), "left_semi")


def _classified(live: DataFrame, src: DataFrame, key: list[str], schema: T.StructType, few: bool,
                filtered: bool = True) -> DataFrame:
    """Source rows to write, with the row key of the row each replaces (NULL for an insert).

    The target is first cut down to the source's keys, by broadcasting them if they are `few`. Otherwise a broadcast bit
    filter of the keys lets candidates through to a shuffle on the key, which the outer join after it shares. Only
    matches go on to that join.
    """
    given = [n for n in src.columns if n not in key]
    values = {n: col(n).cast(schema[n].dataType).alias(n) for n in src.columns}
    src = src.select(*[values[n] for n in src.columns])
    old = live.select(*[col(n) for n in key], *[col(n).alias(f"_old_{n}") for n in live.columns if n not in key])
    old = old.withColumn("_found", F.lit(True))
    keys = src.select(*[col(n) for n in key])
    if not few and filtered:
        old = _may_match(old, keys)
    matches = old.join(F.broadcast(keys) if few else keys, key, "left_semi")
    joined = src.join(matches, key, "left_outer")
    differs = F.col("_found").isNull()
    for n in given:
        differs = differs | ~col(n).eqNullSafe(col(f"_old_{n}"))
    # Columns the source does not have keep their old value.
    rest = [n for n in schema.names if n not in src.columns]
    return joined.where(differs).select(
        F.col("_old__added_in").alias("_prev_in"), F.col("_old__row_id").alias("_prev_id"),
        *[col(n) for n in src.columns], *[col(f"_old_{n}").alias(n) for n in rest],
    )
