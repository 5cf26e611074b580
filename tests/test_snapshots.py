from datetime import datetime, timedelta, timezone

import pytest

from conftest import rows
from tidemark.operators import snapshots as snap
from tidemark.operators.audit import AuditError, audit_values
from tidemark.operators.changes import delete_where, update_where
from tidemark.operators.maintenance import compact, expire, stored_rows
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history, ensure_history, load_history, overwrite
from tidemark.plans import files
from tidemark.plans import history

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(n):
    return T0 + timedelta(hours=n)


def df(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


@pytest.fixture
def h(spark, path):
    return append(create_history(df(spark, 1, 2), path, at=at(1)), df(spark, 3), at=at(2))


def ids(frame):
    return [r["snapshot_id"] for r in frame.orderBy("snapshot_id").collect()]


def test_log_history_and_refs(spark, h):
    h = delete_where(h, "v = 1", at=at(3))
    h = snap.rollback(h, 2, at=at(4))
    log = snap.snapshots(h).orderBy("snapshot_id").collect()
    assert [(r["snapshot_id"], r["parent_id"], r["operation"]) for r in log] == [
        (1, None, "append"), (2, 1, "append"), (3, 2, "delete")
    ]
    assert log[2]["committed_at"] == datetime(2024, 1, 1, 3)
    entries = snap.history(h).orderBy("seq").collect()
    assert [(r["snapshot_id"], r["is_current_ancestor"]) for r in entries] == [
        (1, True), (2, True), (3, False), (2, True)
    ]
    assert entries[-1]["made_current_at"] == datetime(2024, 1, 1, 4)
    assert rows(snap.refs(h)) == [("main", "BRANCH", 2)]
    assert ids(snap.current_snapshot(h)) == [2]
    assert rows(read_at(h)) == [(1,), (2,), (3,)]
    assert rows(read_at(load_history(spark, h.path))) == rows(read_at(h))


def test_rollback_wants_an_ancestor(spark, h):
    h = delete_where(h, "v = 1")
    h = append(snap.rollback(h, 2), df(spark, 4))
    with pytest.raises(ValueError, match="not an ancestor"):
        snap.rollback(h, 3)
    with pytest.raises(ValueError, match="no snapshot"):
        read_at(h, snapshot_id=99)
    assert rows(read_at(h)) == [(1,), (2,), (3,), (4,)]
    assert rows(read_at(h, snapshot_id=3)) == [(2,), (3,)]


def test_branches(spark, h):
    h = snap.create_branch(h, "etl")
    with pytest.raises(ValueError, match="exists"):
        snap.create_branch(h, "etl")
    h = snap.on_branch(h, "etl")
    h = delete_where(h, "v = 1")
    h = append(h, df(spark, 9))
    assert rows(read_at(h)) == [(2,), (3,), (9,)]
    assert rows(read_at(h, branch="main")) == [(1,), (2,), (3,)]
    h = snap.on_branch(h, "main")
    assert rows(read_at(h)) == [(1,), (2,), (3,)]
    done = snap.fast_forward(h, "main", "etl")
    assert rows(read_at(done)) == [(2,), (3,), (9,)]


def test_fast_forward_refuses_diverged_branches(spark, h):
    h = append(snap.create_branch(h, "etl"), df(spark, 9), branch="etl")
    h = append(h, df(spark, 10))
    with pytest.raises(ValueError, match="cannot be fast-forwarded"):
        snap.fast_forward(h, "main", "etl")


def test_drop_branch(spark, h):
    h = delete_where(snap.create_branch(h, "oops"), "v like '%'", branch="oops")
    assert rows(read_at(h, branch="oops")) == []
    h = snap.drop_branch(snap.on_branch(h, "oops"), "oops")
    assert rows(read_at(h)) == [(1,), (2,), (3,)]
    with pytest.raises(ValueError, match="no branch"):
        read_at(h, branch="oops")
    with pytest.raises(ValueError):
        snap.drop_branch(h, "main")


def test_stale_writer_is_refused(spark, h):
    new = append(h, df(spark, 4))
    for change in (lambda: append(h, df(spark, 5)), lambda: delete_where(h, "v = 1"), lambda: compact(h)):
        with pytest.raises(RuntimeError, match="another writer"):
            change()
    assert rows(read_at(new)) == [(1,), (2,), (3,), (4,)]


def test_staging_needs_opt_in(spark, h):
    with pytest.raises(ValueError, match="enable_wap"):
        delete_where(h, "v = 1", wap_id="a")


def test_stage_audit_publish(spark, h):
    h = delete_where(snap.enable_wap(h), "v = 1", wap_id="a")
    assert rows(read_at(h)) == [(1,), (2,), (3,)]
    assert ids(snap.find_staged(h, "a")) == [3]
    assert 3 not in ids(snap.history(h))
    staged = snap.staged_snapshot_id(h, "a")
    view = read_at(h, snapshot_id=staged)
    assert rows(audit_values(view, "v", {2, 3})) == []
    assert rows(audit_values(view, "v", {2, 4})) == [(3, "unexpected"), (4, "missing")]
    with pytest.raises(AuditError, match="missing 4"):
        audit_values(view, "v", {2, 4}, raise_on_fail=True)
    published = snap.cherrypick(h, staged)
    assert published.head() == 3 and rows(read_at(published)) == [(2,), (3,)]
    with pytest.raises(ValueError, match="already"):
        snap.cherrypick(published, staged)


def test_audit_counts_null_as_a_value(spark):
    data = spark.createDataFrame([("a",), (None,)], "s string")
    assert rows(audit_values(data, "s", {"a"})) == [(None, "unexpected")]
    assert rows(audit_values(data, "s", {"a", None})) == []


def test_pick_after_main_moved_on(spark, path):
    h = create_history(df(spark, 1, 2, 3), path)
    h = snap.enable_wap(h)
    h = update_where(h, {"v": "v * 10"}, "v = 2", wap_id="up")
    h = append(h, df(spark, 2))
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "up"))
    assert rows(read_at(h)) == [(1,), (2,), (20,), (3,)]
    assert snap.current_snapshot(h).first()["summary"]["total_rows"] == "4"
    assert snap.current_snapshot(h).first()["summary"]["source_snapshot_id"] == "2"
    with pytest.raises(ValueError, match="already"):
        snap.cherrypick(h, 2)


@pytest.mark.parametrize("bound", [0, 5, 1000])
@pytest.mark.parametrize("meanwhile,left", [("delete", 79), ("compact", 80)])
def test_pick_does_not_depend_on_the_number_of_rows(spark, path, monkeypatch, bound, meanwhile, left):
    monkeypatch.setattr(history, "MAX_BROADCAST_REMOVALS", bound)
    h = snap.enable_wap(create_history(spark.range(0, 100, 1, 4).selectExpr("id", "id % 5 as k"), path))
    h = delete_where(h, "k = 1", wap_id="w")
    if meanwhile == "delete":
        h = delete_where(h, "id = 0")
    else:
        h, _ = compact(h)
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "w"))
    assert read_at(h).count() == left


def test_pick_of_a_staged_full_update_after_compaction(spark, path):
    h = snap.enable_wap(create_history(df(spark, 1, 2), path))
    h = append(h, df(spark, 3))
    h = update_where(h, {"v": "v * 10"}, wap_id="all")
    h, _ = compact(h)
    h = append(h, df(spark, 4))
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "all"))
    assert rows(read_at(h)) == [(10,), (20,), (30,), (4,)]
    again = delete_where(h, "v = 10")
    assert rows(read_at(again)) == [(20,), (30,), (4,)]


def test_pick_of_rows_gone_meanwhile_is_a_conflict(spark, path):
    h = create_history(df(spark, 1, 2, 3), path)
    h = update_where(snap.enable_wap(h), {"v": "20"}, "v = 2", wap_id="up")
    h = delete_where(h, "v = 2")
    with pytest.raises(ValueError, match="conflict"):
        snap.cherrypick(h, snap.staged_snapshot_id(h, "up"))


def test_pick_of_other_rows_is_no_conflict(spark, path):
    h = create_history(df(spark, 1, 2, 3), path)
    h = delete_where(snap.enable_wap(h), "v = 2", wap_id="a")
    h = delete_where(h, "v = 1")
    h, _ = compact(h)
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "a"))
    assert rows(read_at(h)) == [(3,)]


def test_pick_of_staged_overwrite_leaves_later_rows(spark, path):
    h = snap.enable_wap(create_history(df(spark, 1, 2), path))
    h = overwrite(h, df(spark, 7), wap_id="o")
    h = append(h, df(spark, 3))
    h = snap.cherrypick(h, snap.staged_snapshot_id(h, "o"))
    assert rows(read_at(h)) == [(3,), (7,)]


def test_expire_keeps_heads_and_drops_staged(spark, path):
    h = snap.enable_wap(create_history(df(spark, 1, 2), path, at=at(1)))
    h = delete_where(h, "v = 1", at=at(2))
    h = append(h, df(spark, 5), wap_id="never", at=at(3))
    h = snap.create_branch(h, "b")
    h = append(h, df(spark, 6), at=at(4))
    new, counts = expire(h, older_than=at(10), retain_last=100)
    assert ids(snap.snapshots(new)) == [1, 2, 4]
    assert (counts.expired_snapshots, counts.deleted_batches) == (1, 1)
    assert not files.exists(spark, new.rows_path(3))
    assert rows(read_at(new)) == [(2,), (6,)] and rows(read_at(new, snapshot_id=1)) == [(1,), (2,)]
    newer, counts = expire(new, older_than=at(10), retain_last=1)
    assert ids(snap.snapshots(newer)) == [2, 4]
    with pytest.raises(ValueError, match="expired"):
        read_at(newer, snapshot_id=1)
    assert rows(read_at(newer)) == [(2,), (6,)] and rows(read_at(newer, branch="b")) == [(2,)]
    again = load_history(spark, path)
    assert rows(read_at(again)) == [(2,), (6,)]
    assert expire(again, older_than=at(10))[1].deleted_batches == 0


def test_expire_keeps_what_is_new_enough(spark, h):
    h = append(snap.enable_wap(h), df(spark, 5), wap_id="new", at=at(9))
    new, _ = expire(h, older_than=at(9), retain_last=1)
    assert ids(snap.snapshots(new)) == [2, 3]


def test_expire_after_compaction_clears_deleted_rows(spark, path):
    h = create_history(df(spark, 1, 2), path, at=at(1))
    h = delete_where(append(h, df(spark, 3), at=at(2)), "v in (1, 3)", at=at(3))
    assert rows(stored_rows(h).select("v")) == [(1,), (2,), (3,)]
    h, counts = compact(h, at=at(4))
    assert counts.batches_rewritten == 1  # batch 2 lost its only row with the delete
    h, _ = expire(h, older_than=at(5))
    assert rows(stored_rows(h).select("v")) == [(2,)] and rows(read_at(h)) == [(2,)]


def test_picked_rows_outlive_the_staged_snapshot(spark, h):
    h = append(snap.enable_wap(h), df(spark, 5), wap_id="x", at=at(3))
    h = append(h, df(spark, 6), at=at(4))
    h = snap.cherrypick(h, 3, at=at(5))
    h, _ = expire(h, older_than=at(9))
    assert ids(snap.snapshots(h)) == [5]
    assert rows(read_at(h)) == [(1,), (2,), (3,), (5,), (6,)]


def test_empty_history(spark, path):
    h = ensure_history(spark, path, "v long not null")
    assert h.head() is None and rows(read_at(h)) == [] and ids(snap.snapshots(h)) == []
    assert rows(snap.refs(h)) == []
    h = delete_where(h, "v = 1")
    h = append(h, df(spark, 1))
    assert rows(read_at(h)) == [(1,)]
    assert rows(read_at(ensure_history(spark, path, "v long"))) == [(1,)]
