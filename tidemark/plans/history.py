"""Row history: a table's past and present as plain Parquet data plus a small change log.

Data on shared storage, below one folder:

* ``rows/spec=<s>/batch=<n>/attempt=<a>/``: rows written by snapshot n; each attempt to write one has a folder of its
  own, so a writer that is refused in the end has touched nothing that counts. Columns ``_added_in`` (snapshot that first
  wrote the row) and ``_row_id`` identify a row for ever; user columns are stored as ``f<field id>``.
* ``removals/batch=<n>/attempt=<a>/``: the (``_added_in``, ``_row_id``) pairs snapshot n removed, as bit words.
* ``dropped/batch=<n>/attempt=<a>/``: files of other batches whose rows snapshot n, a compaction, has taken over.
* ``stats/batch=<n>/``: facts and column bounds of the files of batch n, where they were gathered.
* ``log/<version>.json``: what each change added to commits, refs, ref log and schema.

A snapshot shows the batches its ancestors wrote, less those a later ancestor replaced, less the removed
rows. Every update, delete and upsert lists the keys of the rows it removes, however many they are, so what a later
operation sees of it does not depend on size. Reads broadcast removals whose counted rows are few and leave other
joins to Spark; ``compact`` rewrites the files that hold removed rows and leaves the others alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import bounds, files, names, partitioning, removals as gone
from tidemark.plans.fields import col, field_id, store_value, stored_name
from tidemark.plans.removals import ROW_KEY

MAX_BROADCAST_REMOVALS = 1_000_000  # bit words, about 100 MB as a hash table; decides the join alone
RESERVED_FACTS = ("added_rows", "removed_rows", "total_rows", "wap.id", "source_snapshot_id")

_KEY_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ROW_KEY])


@dataclass(frozen=True)
class Commit:
    """One snapshot and what it did to the rows."""

    snapshot_id: int
    parent_id: int | None
    source_id: int  # whose rows and removals it applies: itself, or the snapshot it was picked from
    committed_at: str
    operation: str
    summary: dict[str, str]
    spec_id: int = 0
    has_rows: bool = False
    removed: dict[int, int] = field(default_factory=dict)  # _added_in -> rows listed in its removals
    removed_words: int = 0  # in how many bit words
    dropped: dict[int, int] = field(default_factory=dict)  # batch -> how many of its files this one's batch took over
    supersedes: list[int] = field(default_factory=list)  # batches its own batch stands in for
    origins: list[int] = field(default_factory=list)  # _added_in values its batch may hold
    folded: list[int] = field(default_factory=list)  # removals its batch has applied already
    expired: bool = False
    rows_gone: bool = False  # expiry has deleted its batch
    removals_gone: bool = False
    added_rows: int = 0
    removed_rows: int = 0
    total_rows: int = 0  # what the snapshot shows
    attempt: str = ""  # folder of its files below its batch


@dataclass(frozen=True)
class Visible:
    """What a snapshot is made of."""

    batches: list[int]
    removals: list[int]
    partial: dict[int, list[int]] = field(default_factory=dict)  # batch -> compactions that took some of its files


@dataclass(frozen=True)
class History:
    """A history at one version of its log. Changing operators return the next one."""

    spark: SparkSession = field(repr=False, compare=False)
    path: str
    version: int
    schema: T.StructType
    next_field_id: int
    specs: list[list[tuple[str, int]]]  # per spec id: (transform, field id)
    spec_id: int
    key: list[str]
    properties: dict[str, str]
    commits: dict[int, Commit] = field(repr=False)
    refs: dict[str, int | None]
    ref_log: list[dict] = field(repr=False)
    branch: str = "main"  # default of reads and writes made through this object
    attempt: str = field(default="", repr=False, compare=False)  # folder of what is being written

    # -- log ------------------------------------------------------------------------------------

    @staticmethod
    def load(spark: SparkSession, path: str) -> History:
        """Open a saved history by replaying its log."""
        lines = (
            spark.read.option("wholetext", True)
            .text(f"{path}/log/*.json")
            .select(F.col("_metadata.file_name").alias("name"), "value")
            .orderBy("name")
            .collect()
        )
        commits: dict[int, Commit] = {}
        ref_log: list[dict] = []
        head: dict = {}
        for line in lines:
            head = json.loads(line["value"])
            for raw in head.pop("commits"):
                for name in ("removed", "dropped"):
                    raw[name] = {int(k): v for k, v in raw.get(name, {}).items()}
                commits[raw["snapshot_id"]] = Commit(**raw)
            ref_log += head.pop("ref_log")
        head["schema"] = T.StructType.fromJson(head["schema"])
        head["specs"] = [[tuple(part) for part in spec] for spec in head["specs"]]
        return History(spark=spark, path=path, commits=commits, ref_log=ref_log, **head)

    def save(self, commits: Iterable[Commit] = (), moves: Iterable[tuple[str, int | None]] = (),
             at: datetime | None = None, **changes) -> History:
        """Write the next log version: new or changed commits, ref moves and changed settings."""
        commits, refs, lines = list(commits), dict(changes.pop("refs", self.refs)), []
        by_id = {**self.commits, **{c.snapshot_id: c for c in commits}}
        for name, snapshot_id in moves:
            refs[name] = snapshot_id
            lines.append({
                "seq": len(self.ref_log) + len(lines) + 1,
                "made_current_at": _iso(at),
                "ref": name,
                "snapshot_id": snapshot_id,
                "parent_id": by_id[snapshot_id].parent_id,
            })
        new = replace(self, version=self.version + 1, commits=by_id, refs=refs,
                      ref_log=self.ref_log + lines, **changes)
        record = {
            "version": new.version,
            "schema": new.schema.jsonValue(),
            "next_field_id": new.next_field_id,
            "specs": new.specs,
            "spec_id": new.spec_id,
            "key": new.key,
            "properties": new.properties,
            "refs": new.refs,
            "commits": [asdict(c) for c in commits],
            "ref_log": lines,
        }
        files.write_new_text(self.spark, self._log_file(new.version), json.dumps(record))
        if names.NAMES in new.properties or names.NAMES in self.properties:
            names.publish(new, self)
        return new

    def commit(self, operation: str, *, snapshot_id: int, added_rows: int = 0, removed_rows: int = 0,
               branch: str | None = None, wap_id: str | None = None, at: datetime | None = None,
               summary: dict[str, str] | None = None, source: Commit | None = None, picked: int | None = None,
               **effect) -> History:
        """Record a snapshot on a branch head, or staged beside it when `wap_id` is given.

        Row counts are fields of the commit; its summary repeats them for readers and is never read back.
        """
        taken = sorted(set(RESERVED_FACTS).intersection(summary or {}))
        if taken:
            raise ValueError(f"summary keys {taken} are reserved")
        branch = branch or self.branch
        parent = self.head(branch)
        total_rows = self.total_rows(parent) + added_rows - removed_rows
        facts = {
            **(summary or {}),
            "added_rows": str(added_rows),
            "removed_rows": str(removed_rows),
            "total_rows": str(total_rows),
        }
        if picked is not None:
            facts["source_snapshot_id"] = str(picked)
        if wap_id is not None:
            facts["wap.id"] = wap_id
        new = Commit(
            snapshot_id=snapshot_id,
            parent_id=parent,
            source_id=source.source_id if source else snapshot_id,
            committed_at=_iso(at),
            operation=operation,
            summary=facts,
            added_rows=added_rows,
            removed_rows=removed_rows,
            total_rows=total_rows,
            attempt=self.attempt,
            **effect,
        )
        moves = [] if wap_id is not None else [(branch, snapshot_id)]
        return self.save([new], moves, at)

    def total_rows(self, snapshot_id: int | None) -> int:
        return self.commits[snapshot_id].total_rows if snapshot_id is not None else 0

    def writable(self, wap_id: str | None = None) -> History:
        """This history with a fresh folder to write to. A writer that is behind the log already is refused."""
        if wap_id is not None and self.properties.get("wap.enabled") != "true":
            raise ValueError("staging under a wap_id needs enable_wap(h) first")
        if files.exists(self.spark, self._log_file(self.version + 1)):
            raise files.BehindLog(f"another writer moved the history at {self.path} on; load it again")
        return replace(self, attempt=uuid.uuid4().hex)

    def _log_file(self, version: int) -> str:
        return f"{self.path}/log/{version:010d}.json"

    # -- snapshots ------------------------------------------------------------------------------

    @property
    def next_snapshot_id(self) -> int:
        return max(self.commits, default=0) + 1

    def head(self, branch: str | None = None) -> int | None:
        branch = branch or self.branch
        if branch not in self.refs:
            raise ValueError(f"no branch {branch!r}; branches are {sorted(self.refs)}")
        return self.refs[branch]

    def lineage(self, snapshot_id: int | None) -> list[int]:
        """The snapshot and its ancestors, oldest first."""
        out = []
        while snapshot_id is not None:
            out.append(snapshot_id)
            snapshot_id = self.commits[snapshot_id].parent_id
        return out[::-1]

    def source_of(self, snapshot_id: int) -> Commit:
        """The commit whose rows and removals a snapshot applies."""
        return self.commits[self.commits[snapshot_id].source_id]

    def visible(self, snapshot_id: int | None) -> Visible:
        batches: dict[int, None] = {}
        removals: list[int] = []
        partial: dict[int, list[int]] = {}
        for s in self.lineage(snapshot_id):
            c, source = self.commits[s], self.source_of(s)
            # Batches are replaced as a whole on the line they were replaced on. A picked snapshot removes rows by
            # their keys: those its source listed, or those it listed itself.
            for b in c.supersedes:
                batches.pop(b, None)
                partial.pop(b, None)
            for b in c.dropped:
                partial.setdefault(b, []).append(s)
            if source.has_rows:
                batches[source.snapshot_id] = None
            listed = c if c.removed else source
            if listed.removed:
                removals.append(listed.snapshot_id)
        return Visible(list(batches), removals, partial)

    def removals_of(self, seen: Visible) -> dict[int, list[int]]:
        """Per visible batch, the removals that may hit its rows."""
        by_origin: dict[int, list[int]] = {}
        for r in seen.removals:
            for origin in self.commits[r].removed:
                by_origin.setdefault(origin, []).append(r)
        out = {}
        for b in seen.batches:
            c = self.commits[b]
            hits = {r for o in c.origins for r in by_origin.get(o, ())}
            # a compaction takes over every file that holds removed rows
            out[b] = sorted(hits.difference(c.folded, *(self.commits[p].folded for p in seen.partial.get(b, ()))))
        return out

    def holding(self, seen: Visible, origins: Iterable[int]) -> list[int]:
        """The visible batches that may hold rows first written by any of `origins`."""
        origins = set(origins)
        return [b for b in seen.batches if not origins.isdisjoint(self.commits[b].origins)]

    def removal_words(self, removals: Iterable[int]) -> int:
        return sum(self.commits[r].removed_words for r in set(removals))

    # -- files ----------------------------------------------------------------------------------

    def rows_path(self, batch: int, spec_id: int | None = None) -> str:
        spec_id = self.commits[batch].spec_id if spec_id is None else spec_id
        return f"{self.path}/rows/spec={spec_id}/batch={batch}/attempt={self._attempt(batch)}"

    def removals_path(self, batch: int) -> str:
        return f"{self.path}/removals/batch={batch}/attempt={self._attempt(batch)}"

    def dropped_path(self, batch: int) -> str:
        return f"{self.path}/dropped/batch={batch}/attempt={self._attempt(batch)}"

    def dropped_files(self, seen: Visible, batches: Iterable[int]) -> list[str]:
        """Files of these batches whose rows are in another batch by now."""
        batches = set(batches)
        paths = sorted({self.dropped_path(p) for b in batches for p in seen.partial.get(b, ())})
        if not paths:
            return []
        names = self.spark.read.schema("batch long, file string").parquet(*paths)
        return [r["file"] for r in names.where(F.col("batch").isin(sorted(batches))).select("file").distinct().collect()]

    def _attempt(self, batch: int) -> str:
        return self.commits[batch].attempt if batch in self.commits else self.attempt

    def spec(self, spec_id: int) -> list[tuple[str, T.StructField]]:
        by_id = {field_id(f): f for f in self.schema}
        return [(transform, by_id[fid]) for transform, fid in self.specs[spec_id]]

    @staticmethod
    def _partition_name(transform: str, f: T.StructField) -> str:
        return f"p{field_id(f)}_{transform}"

    def stored_schema(self, spec_id: int) -> T.StructType:
        """What files written under a spec hold, with the columns their folders stand for."""
        return T.StructType(
            _KEY_SCHEMA.fields
            + [T.StructField(stored_name(f), f.dataType) for f in self.schema]
            + [
                T.StructField(self._partition_name(t, f), partitioning.derived_type(t, f.dataType))
                for t, f in self.spec(spec_id)
            ]
        )

    # -- reads ----------------------------------------------------------------------------------

    def scan(self, spec_id: int, batches: list[int], prune: Prune | None = None, extra: Iterable[Column] = (),
             chosen: Iterable[Column] = ()) -> DataFrame:
        """Rows of batches that share a partition spec, under their current column names.

        `extra` may add columns of the scan itself, such as the file a row is in; `chosen` are conditions on the file,
        which leave files out before any is opened.
        """
        spec = self.spec(spec_id)
        df = (
            self.spark.read.schema(
                self.stored_schema(spec_id).add("batch", T.LongType()).add("attempt", T.StringType()))
            .option("basePath", f"{self.path}/rows/spec={spec_id}")
            .parquet(*[self.rows_path(b, spec_id) for b in batches])
        )
        for transform, f in spec:
            bound = prune(transform, f, F.col(self._partition_name(transform, f))) if prune else None
            if bound is not None:
                df = df.where(bound)
        for condition in chosen:
            df = df.where(condition)
        return df.select(*ROW_KEY, *[
            F.col(stored_name(f)).alias(f.name, metadata=f.metadata) for f in self.schema
        ], *extra)

    def partition_listing(self, spec_id: int, batches: list[int], prune: Prune) -> DataFrame:
        """(file, length) of files whose partition folders pass `prune`; no file is opened."""
        schema = T.StructType([
            T.StructField(n, t) for n, t in (("path", T.StringType()), ("modificationTime", T.TimestampType()),
                                             ("length", T.LongType()), ("content", T.BinaryType()))])
        for t, f in self.spec(spec_id):
            schema = schema.add(self._partition_name(t, f), partitioning.derived_type(t, f.dataType))
        df = (
            self.spark.read.format("binaryFile")
            .schema(schema.add("batch", T.LongType()).add("attempt", T.StringType()))
            .option("basePath", f"{self.path}/rows/spec={spec_id}").option("pathGlobFilter", "*.parquet")
            .load([self.rows_path(b, spec_id) for b in batches])
        )
        for t, f in self.spec(spec_id):
            bound = prune(t, f, F.col(self._partition_name(t, f)))
            if bound is not None:
                df = df.where(bound)
        return df.select(files.file_name().alias("file"), "length")

    def read_removals(self, removals: Iterable[int]) -> DataFrame:
        """What snapshots removed, as bit words."""
        paths = [self.removals_path(r) for r in sorted(set(removals))]
        return self.spark.read.schema(gone.SCHEMA).parquet(*paths)

    def visible_files(self, seen: Visible, batches: Iterable[int]) -> list[Column]:
        """Conditions on the file that a read of these batches must make."""
        dropped = self.dropped_files(seen, batches)
        return [~files.file_name().isin(dropped)] if dropped else []

    def rows_of(self, seen: Visible, hits: dict[int, list[int]], batches: Iterable[int] | None = None,
                prune: Prune | None = None, chosen: Iterable[Column] = ()) -> DataFrame:
        """Live rows with their row keys, of some or all visible batches. Batches no removal hits are not joined."""
        groups: dict[tuple[int, bool], list[int]] = {}
        for b in seen.batches if batches is None else batches:
            groups.setdefault((self.commits[b].spec_id, bool(hits.get(b))), []).append(b)
        parts = []
        for (spec_id, dirty), members in sorted(groups.items()):
            df = self.scan(spec_id, members, prune, chosen=[*self.visible_files(seen, members), *chosen])
            if dirty:
                df = gone.without(df, self.removals_to_join({r for b in members for r in hits[b]}))
            parts.append(df)
        if not parts:
            empty = T.StructType(_KEY_SCHEMA.fields + [
                T.StructField(f.name, f.dataType, True, f.metadata) for f in self.schema
            ])
            return self.spark.createDataFrame([], empty)
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def removals_to_join(self, removals: Iterable[int]) -> DataFrame:
        """Removals for a join; broadcast where their counted words are few."""
        words = self.read_removals(removals)
        return F.broadcast(words) if self.few_removals(removals) else words

    def few_removals(self, removals: Iterable[int]) -> bool:
        return self.removal_words(removals) <= MAX_BROADCAST_REMOVALS

    def live(self, snapshot_id: int | None, prune: Prune | None = None, chosen: Iterable[Column] = ()) -> DataFrame:
        """All rows a snapshot shows, with their row keys."""
        seen = self.visible(snapshot_id)
        return self.rows_of(seen, self.removals_of(seen), prune=prune, chosen=chosen)

    # -- writes ---------------------------------------------------------------------------------

    def write_rows(self, batch: int, df: DataFrame, *, keep_keys: Column | None = None,
                   extra: Iterable[str] = (), files_wanted: int | None = None, rows_total: int | None = None,
                   target_bytes: int | None = None) -> None:
        """Write rows into a batch folder under the current spec.

        `df` holds user columns by name; where it has row keys, rows for which `keep_keys` is true keep
        them. Other rows are numbered after any shuffle, in the task that writes them. `files_wanted`
        merges input splits and, with `rows_total`, cuts files that would come out larger, both without
        a shuffle; a partitioned spec rebalances on its columns to about `target_bytes` instead.
        """
        spec = self.spec(self.spec_id)
        parts = [self._partition_name(t, f) for t, f in spec]
        keys = ROW_KEY if keep_keys is not None else []
        values = [
            (store_value(col(f.name), f) if f.name in df.columns
             else store_value(F.lit(None), f)).alias(stored_name(f))
            for f in self.schema
        ]
        derived = [
            partitioning.derive(t, col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType),
                                f.dataType).alias(p)
            for p, (t, f) in zip(parts, spec)
        ]
        kept = [keep_keys.alias("_keep")] if keep_keys is not None else []
        out = df.select(*keys, *kept, *extra, *values, *derived)
        if files_wanted and not parts and not self.cluster_field:
            out = out.coalesce(files_wanted)
        added, row_id = F.lit(batch).cast("long"), F.monotonically_increasing_id()
        if keep_keys is not None:
            added = F.when(F.col("_keep"), F.col("_added_in")).otherwise(added)
            row_id = F.when(F.col("_keep"), F.col("_row_id")).otherwise(row_id)
        stored = [stored_name(f) for f in self.schema]
        clustered = self.cluster_field

        def write(rows: DataFrame) -> None:
            writer = (
                rows.select(added.alias("_added_in"), row_id.alias("_row_id"), *extra, *stored, *parts)
                .write.partitionBy(*parts)
            )
            if files_wanted and rows_total and not parts:
                writer = writer.option("maxRecordsPerFile", -(-rows_total // files_wanted))
            writer.parquet(self.rows_path(batch, self.spec_id))

        if clustered and not parts:
            size = target_bytes or self.target_file_bytes
            partitioning.write_ranged(out, stored_name(clustered), write, size, files_wanted)
        elif files_wanted and not parts:
            write(out)
        else:
            partitioning.write_gathered(out, parts, write, target_bytes or self.target_file_bytes)
        if self.properties.get("gather_stats") == "true":
            bounds.gather(self, [batch], {batch: self.spec_id})

    @property
    def cluster_field(self) -> T.StructField | None:
        """The column that new files are laid out by."""
        fid = self.properties.get("cluster.field_id")
        return next((f for f in self.schema if str(field_id(f)) == fid), None) if fid else None

    @property
    def target_file_bytes(self) -> int | None:
        """The size new files should come out at, where the table sets one."""
        value = self.properties.get("target_file_bytes")
        return int(value) if value else None

    def written(self, batch: int, extra: T.StructType = T.StructType([])) -> DataFrame:
        """Row keys (and bookkeeping columns) of a batch folder as written."""
        schema = T.StructType(_KEY_SCHEMA.fields + extra.fields)
        return self.spark.read.schema(schema).parquet(self.rows_path(batch, self.spec_id))

    def write_removals(self, batch: int, keys: DataFrame) -> None:
        gone.words_of(keys).write.parquet(self.removals_path(batch))

    def listed(self, batch: int) -> dict:
        """What was just listed for removal, as the commit's facts: rows by `_added_in`, and words."""
        removed, words = gone.counted(self.read_removals([batch]))
        return {"removed": removed, "removed_words": words}


# Given (transform, field, partition column), a filter on that column or None.
Prune = Callable[[str, T.StructField, Column], Column | None]


def _iso(at: datetime | None) -> str:
    at = at or datetime.now(timezone.utc)
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return at.astimezone(timezone.utc).isoformat(timespec="microseconds")

