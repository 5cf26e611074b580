"""Snapshots, branches, time travel and publishing. None of these moves any row."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import files
from tidemark.plans.fields import col
from tidemark.plans.history import RESERVED_FACTS, History, Visible
from tidemark.plans.removals import ROW_KEY, keys_of

# What the queries below need of a log file.
_LOG = """
version long, refs map<string,long>,
commits array<struct<snapshot_id:long,parent_id:long,committed_at:string,operation:string,summary:map<string,string>,
                     expired:boolean>>,
ref_log array<struct<seq:long,made_current_at:string,ref:string,snapshot_id:long,parent_id:long>>
"""


# -- reading --------------------------------------------------------------------------------------


def read_at(h: History, snapshot_id: int | None = None, branch: str | None = None) -> DataFrame:
    """Rows as of a snapshot, or of a branch head; columns as of now."""
    if snapshot_id is None:
        snapshot_id = h.head(branch)
    elif branch is not None:
        raise ValueError("give a snapshot_id or a branch, not both")
    else:
        _check_snapshot(h, snapshot_id)
    return h.live(snapshot_id).select(*[col(f.name) for f in h.schema])


def _check_snapshot(h: History, snapshot_id: int) -> None:
    if snapshot_id not in h.commits or h.commits[snapshot_id].expired:
        raise ValueError(f"no snapshot {snapshot_id}, or it has expired")


def register_view(h: History, name: str, branch: str | None = None) -> None:
    """(Re-)register a temporary view over a branch head; call again after a commit.

    `attach_history` gives a history a name that follows its commits.
    """
    read_at(h, branch=branch).createOrReplaceTempView(name)


# -- logs -----------------------------------------------------------------------------------------


def _log(h: History) -> DataFrame:
    """The log files up to this version, one row each."""
    return h.spark.read.schema(_LOG).json(f"{h.path}/log/*.json").where(F.col("version") <= h.version)


def snapshots(h: History) -> DataFrame:
    """All snapshots that have not expired, staged ones included. A commit counts as its newest log file has it."""
    lines = _log(h).select("version", F.explode("commits").alias("c"))
    newest = lines.groupBy(F.col("c.snapshot_id").alias("snapshot_id")).agg(F.max_by("c", "version").alias("c"))
    return newest.where(~F.col("c.expired")).select(
        "snapshot_id", "c.parent_id", F.col("c.committed_at").cast("timestamp").alias("committed_at"), "c.operation",
        "c.summary")


def current_snapshot(h: History, ref: str | None = None) -> DataFrame:
    """The snapshot a branch points to (no row for an empty branch)."""
    h.head(ref)  # an unknown branch is an error
    head = refs(h).where(F.col("name") == (ref or h.branch)).select("snapshot_id")
    return snapshots(h).join(F.broadcast(head), "snapshot_id", "left_semi")  # one row


def history(h: History, ref: str = "main") -> DataFrame:
    """Which snapshots were current on a branch, and whether each is an ancestor of the current one."""
    ancestors = h.lineage(h.head(ref))
    moves = _log(h).select(F.explode("ref_log").alias("m")).where(F.col("m.ref") == ref)
    return moves.select(
        "m.seq", F.col("m.made_current_at").cast("timestamp").alias("made_current_at"), "m.snapshot_id", "m.parent_id",
        F.col("m.snapshot_id").isin(ancestors).alias("is_current_ancestor"))


def refs(h: History) -> DataFrame:
    """Branches and the snapshots they point to; the newest log file has them all."""
    newest = _log(h).agg(F.max_by("refs", "version").alias("refs"))
    return newest.select(F.explode("refs").alias("name", "snapshot_id")).where("snapshot_id IS NOT NULL").select(
        "name", F.lit("BRANCH").alias("type"), "snapshot_id")


# -- moving refs ----------------------------------------------------------------------------------


def rollback(h: History, snapshot_id: int, branch: str | None = None, *, at: datetime | None = None) -> History:
    """Make an ancestor current again. The log gains an entry with the old id; the schema stays."""
    branch = branch or h.branch
    _check_snapshot(h, snapshot_id)
    if snapshot_id not in h.lineage(h.head(branch)):
        raise ValueError(f"snapshot {snapshot_id} is not an ancestor of {branch!r}")
    return h.save(moves=[(branch, snapshot_id)], at=at)


def create_branch(h: History, name: str, from_ref: str | None = None, *, at: datetime | None = None) -> History:
    if name in h.refs:
        raise ValueError(f"branch {name!r} exists already")
    head = h.head(from_ref)
    if head is None:
        raise ValueError("an empty table has no snapshot to branch from")
    return h.save(moves=[(name, head)], at=at)


def drop_branch(h: History, name: str) -> History:
    """Forget a branch and with it every change only it shows."""
    if name == "main":
        raise ValueError("main cannot be dropped")
    h.head(name)
    new = h.save(refs={n: s for n, s in h.refs.items() if n != name})
    return replace(new, branch="main") if new.branch == name else new


def on_branch(h: History, name: str) -> History:
    """The same history with `name` as the branch that reads and writes use by default."""
    h.head(name)
    return replace(h, branch=name)


def fast_forward(h: History, branch: str, to: str, *, at: datetime | None = None) -> History:
    """Move a branch to the head of another that is ahead of it."""
    head, goal = h.head(branch), h.head(to)
    if head is not None and head not in h.lineage(goal):
        raise ValueError(f"{branch!r} has commits that {to!r} lacks; it cannot be fast-forwarded")
    return h.save(moves=[(branch, goal)] if goal is not None and goal != head else [], at=at)


# -- write, audit, publish ------------------------------------------------------------------------


def enable_wap(h: History) -> History:
    """Allow staging: from here on writes may carry a `wap_id`."""
    return set_properties(h, {"wap.enabled": "true"})


def find_staged(h: History, wap_id: str) -> DataFrame:
    """The snapshots staged under an audit session's id."""
    return snapshots(h).where(F.col("summary")["wap.id"] == wap_id)


def staged_snapshot_id(h: History, wap_id: str) -> int:
    found = [c.snapshot_id for c in h.commits.values() if not c.expired and c.summary.get("wap.id") == wap_id]
    if len(found) != 1:
        raise ValueError(f"{len(found)} snapshots are staged under {wap_id!r}")
    return found[0]


def cherrypick(h: History, snapshot_id: int, branch: str | None = None, *, at: datetime | None = None) -> History:
    """Publish one snapshot on a branch.

    If the branch has not moved since, it just moves on to the snapshot. Otherwise a new snapshot applies
    the same rows and removals; it is refused if rows it changes were changed on the branch meanwhile.
    """
    branch = branch or h.branch
    _check_snapshot(h, snapshot_id)
    head, picked = h.head(branch), h.commits[snapshot_id]
    source = h.source_of(snapshot_id)
    if source.source_id in {h.commits[s].source_id for s in h.lineage(head)}:
        raise ValueError(f"{branch!r} has snapshot {snapshot_id} already")
    if picked.parent_id == head:
        return h.save(moves=[(branch, snapshot_id)], at=at)
    if picked.operation == "replace":
        raise ValueError(f"snapshot {snapshot_id} is a compaction; it changes no rows to publish")
    h = h.writable()
    batch, now, then = h.next_snapshot_id, h.visible(head), h.visible(picked.parent_id)
    effect = {}
    if source.dropped:
        # A partition was dropped by its files; elsewhere the same rows go by their keys.
        base = Visible(sorted(source.dropped), [], {b: [source.snapshot_id] for b in source.dropped})
        lost = [files.file_name().isin(h.dropped_files(base, base.batches))]
        gone = h.rows_of(then, h.removals_of(then), base.batches, chosen=lost).select(*ROW_KEY)
        origins = {o for b in base.batches for o in h.commits[b].origins}
        if source.removed:
            gone = gone.union(keys_of(h.read_removals([source.snapshot_id])))
            origins |= set(source.removed)
        h.write_removals(batch, gone)
        effect = h.listed(batch)
    elif source.removed:
        gone, origins = keys_of(h.read_removals([source.snapshot_id])), set(source.removed)
    else:
        # A full update or overwrite lists no keys; what it removed is all that its base showed.
        gone = h.rows_of(then, h.removals_of(then), source.supersedes).select(*ROW_KEY)
        origins = {o for b in source.supersedes for o in h.commits[b].origins}
        if source.supersedes:
            h.write_removals(batch, gone)
            effect = h.listed(batch)
    _check_conflicts(h, now, then, gone, origins)
    facts = {k: v for k, v in picked.summary.items() if k not in RESERVED_FACTS}
    return h.commit(
        picked.operation, snapshot_id=batch, branch=branch, at=at, source=source, picked=snapshot_id,
        added_rows=picked.added_rows, removed_rows=picked.removed_rows, summary=facts, **effect,
    )


def _check_conflicts(h: History, now: Visible, then: Visible, gone: DataFrame, origins: set[int]) -> None:
    """Rows that a picked snapshot removes must be live on the branch; decided by their keys, whatever holds them."""
    held = h.holding(then, origins)
    new_removals = set(now.removals) - set(then.removals)
    untouched = set(held) <= set(now.batches) and not any(
        not origins.isdisjoint(h.commits[r].removed) for r in new_removals)
    if untouched:
        return  # the log alone tells
    alive = h.rows_of(now, h.removals_of(now), h.holding(now, origins)).select(*ROW_KEY)
    if not gone.join(alive, ROW_KEY, "left_anti").isEmpty():
        raise ValueError("conflict: rows the snapshot removes are no longer live on the branch")


def set_properties(h: History, values: dict[str, str]) -> History:
    return h.save(properties={**h.properties, **values})


def unset_properties(h: History, *names: str) -> History:
    return h.save(properties={k: v for k, v in h.properties.items() if k not in names})
