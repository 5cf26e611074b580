import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators.changes import UpsertCounts, delete_where, update_where, upsert
from tidemark.operators.evolve import add_column, rename_column
from tidemark.operators.snapshots import read_at, snapshots
from tidemark.operators.writes import append, create_history, load_history, overwrite
from tidemark.operators import changes
from tidemark.plans import history
from tidemark.plans.files import BehindLog

# Commits of a code host: appended, appended again, then upserted with one identical and one changed row.
FIRST = [(123, "Fix bug", "Open", 22, 10), (234, "Add variant type", "Open", 29123, 302),
         (345, "Add commit retries", "Open", 22, 10)]
SECOND = [(456, "Add nanosecond times", "Merged", 2392, 8), (567, "Document filters", "Open", 7543, 3)]
COMMITS = "id long, name string, state string, additions long, deletes long"


@pytest.fixture(params=[1_000_000, 0], ids=["broadcast", "shuffled"], autouse=True)
def bound(request, monkeypatch):
    """Both joins against the removals; nothing else may depend on their number."""
    monkeypatch.setattr(history, "MAX_BROADCAST_REMOVALS", request.param)


def make(spark, path, data, schema, **kw):
    return create_history(spark.createDataFrame(data, schema), path, **kw)


def test_upsert_inserts_updates_and_skips(spark, path):
    h = make(spark, path, FIRST, COMMITS, key=["id"])
    h = append(h, spark.createDataFrame(SECOND, COMMITS))
    src = spark.createDataFrame(
        [SECOND[0], (567, "Document filters", "Merged", 9238, 22), (678, "New", "Open", 1, None)], COMMITS
    )
    h, counts = upsert(h, src)
    assert counts == UpsertCounts(inserted=1, updated=1, unchanged=1)
    assert rows(read_at(h)) == sorted(FIRST + [SECOND[0], (567, "Document filters", "Merged", 9238, 22),
                                               (678, "New", "Open", 1, None)])
    assert rows(read_at(h, snapshot_id=2)) == sorted(FIRST + SECOND)
    again, counts = upsert(h, src)
    assert counts == UpsertCounts(0, 0, 3)
    assert again is h
    assert rows(read_at(load_history(spark, path))) == rows(read_at(h))


def test_upsert_with_few_source_columns_keeps_the_rest(spark, path):
    h = make(spark, path, FIRST, COMMITS, key=["id"])
    h, counts = upsert(h, spark.createDataFrame([(123, "Closed"), (999, "Open")], "id long, state string"))
    assert counts == UpsertCounts(1, 1, 0)
    found = rows(read_at(h).where("id in (123, 999)"))
    assert found == [(123, "Fix bug", "Closed", 22, 10), (999, None, "Open", None, None)]


def test_upsert_rejects_bad_keys(spark, path):
    h = make(spark, path, FIRST + [FIRST[0]], COMMITS, key=["id"])
    for bad, message in [
        ([(1, "a", "b", 1, 1), (1, "a", "b", 2, 2)], "more than one row"),
        ([(None, "a", "b", 1, 1)], "NULL key"),
        ([(123, "a", "b", 1, 1)], "the table has more than one row"),
    ]:
        with pytest.raises(ValueError, match=message):
            upsert(h, spark.createDataFrame(bad, COMMITS))
    with pytest.raises(ValueError, match="needs a key"):
        upsert(make(spark, path + "2", FIRST, COMMITS), spark.createDataFrame(FIRST, COMMITS))
    with pytest.raises(ValueError, match="same result each time"):
        upsert(h, spark.createDataFrame(FIRST, COMMITS).withColumn("additions", (F.rand() * 9).cast("long")))


def test_upsert_treats_null_and_nan_as_values(spark, path):
    data = [(1, None), (2, float("nan")), (3, 1.0)]
    h = make(spark, path, data, "k long, v double", key=["k"])
    _, counts = upsert(h, spark.createDataFrame(data, "k long, v double"))
    assert counts == UpsertCounts(0, 0, 3)
    _, counts = upsert(h, spark.createDataFrame([(1, 5.0), (3, None)], "k long, v double"))
    assert counts == UpsertCounts(0, 2, 0)


def test_upsert_on_two_keys(spark, path):
    h = make(spark, path, [(1, "a", 1), (1, "b", 2)], "k long, s string, v int", key=["k", "s"])
    h, counts = upsert(h, spark.createDataFrame([(1, "b", 3), (2, "b", 4)], "k long, s string, v int"))
    assert counts == UpsertCounts(1, 1, 0)
    assert rows(read_at(h)) == [(1, "a", 1), (1, "b", 3), (2, "b", 4)]


def test_delete_keeps_rows_whose_condition_is_null(spark, path):
    data = [(1, 2.0), (2, None), (3, 9.0)]
    h = make(spark, path, data, "id long, x double")
    h = delete_where(h, "x > 4.0")
    assert rows(read_at(h)) == [(1, 2.0), (2, None)]
    h = delete_where(h, "x is null")
    assert rows(read_at(h)) == [(1, 2.0)]
    h = delete_where(h, "x like '%'")
    assert rows(read_at(h)) == []
    assert rows(read_at(h, snapshot_id=1)) == data
    log = {r["snapshot_id"]: r["summary"] for r in snapshots(h).collect()}
    assert [(log[i]["removed_rows"], log[i]["total_rows"]) for i in (1, 2, 3, 4)] == [
        ("0", "3"), ("1", "2"), ("1", "1"), ("1", "0")
    ]


def test_delete_of_nothing_still_makes_a_snapshot(spark, path):
    h = delete_where(make(spark, path, [(1,)], "id long"), "id > 5")
    assert h.head() == 2 and rows(read_at(h)) == [(1,)]


def test_delete_of_whole_batches_leaves_them_out_of_reads(spark, path):
    h = make(spark, path, [(1, "a"), (2, "a")], "id long, day string")
    h = append(h, spark.createDataFrame([(3, "b"), (4, "c")], "id long, day string"))
    h = delete_where(h, "day in ('a', 'b')")
    assert h.commits[3].supersedes == [1]
    assert h.commits[3].removed == {1: 2, 2: 1}
    assert h.visible(h.head()).batches == [2]
    h = delete_where(h, "id = 4")
    assert not h.visible(h.head()).batches
    assert rows(read_at(h)) == [] and rows(read_at(h, snapshot_id=3)) == [(4, "c")]


def test_update_sees_the_old_row_and_casts(spark, path):
    h = make(spark, path, [(1, 10.0, 2.0), (2, 10.0, 0.0), (3, None, 1.0)], "id long, fare double, d double")
    h = update_where(h, {"fare": F.col("d"), "d": F.col("fare")}, "id <> 3")
    assert rows(read_at(h)) == [(1, 2.0, 10.0), (2, 0.0, 10.0), (3, None, 1.0)]
    h = update_where(h, {"fare": "try_divide(fare, fare)"})
    assert rows(read_at(h)) == [(1, 1.0, 10.0), (2, None, 10.0), (3, None, 1.0)]
    h = update_where(h, {"d": "7"}, "fare is null")
    assert rows(read_at(h)) == [(1, 1.0, 10.0), (2, None, 7.0), (3, None, 7.0)]
    assert rows(read_at(h, snapshot_id=2)) == [(1, 2.0, 10.0), (2, 0.0, 10.0), (3, None, 1.0)]


def test_update_with_random_values_is_written_once(spark, path):
    h = make(spark, path, [(i, 0.0) for i in range(50)], "id long, x double")
    h = update_where(h, {"x": F.rand()}, "id < 40")
    assert rows(read_at(h)) == rows(read_at(h))
    assert read_at(h).count() == 50


def test_random_conditions_are_refused(spark, path):
    h = make(spark, path, [(1,)], "id long")
    for change in (lambda: delete_where(h, F.rand() > 0.5), lambda: update_where(h, {"id": "2"}, F.rand() > 0.5)):
        with pytest.raises(ValueError, match="same result each time"):
            change()


def test_update_of_unknown_column(spark, path):
    h = make(spark, path, [(1,)], "id long")
    with pytest.raises(ValueError, match="no column"):
        update_where(h, {"nope": "1"})


def test_overwrite_keeps_old_rows_in_history(spark, path):
    h = make(spark, path, [(1,), (2,)], "id long")
    h = overwrite(h, read_at(h).where("id = 2").union(spark.createDataFrame([(3,)], "id long")))
    assert rows(read_at(h)) == [(2,), (3,)]
    assert rows(read_at(h, snapshot_id=1)) == [(1,), (2,)]


def test_a_writer_that_is_refused_late_destroys_nothing(spark, path, monkeypatch):
    h = make(spark, path, [(1,)], "id long")
    behind = load_history(spark, path)
    checked = type(h).writable

    def overtaken(self, wap_id=None):
        ready = checked(self, wap_id)
        monkeypatch.setattr(type(h), "writable", checked)
        append(h, spark.createDataFrame([(10,), (11,)], "id long"))  # between the check and the write
        return ready

    monkeypatch.setattr(type(h), "writable", overtaken)
    with pytest.raises(BehindLog):
        append(behind, spark.createDataFrame([(20,), (21,), (22,)], "id long"))
    assert rows(read_at(load_history(spark, path))) == [(1,), (10,), (11,)]


def test_a_summary_cannot_change_what_is_counted(spark, path):
    h = make(spark, path, [(i,) for i in range(20)], "id long")
    for key in ("added_rows", "removed_rows", "total_rows", "wap.id", "source_snapshot_id"):
        with pytest.raises(ValueError, match="reserved"):
            append(h, spark.createDataFrame([(1,)], "id long"), summary={key: "3"})
    h = append(h, spark.range(20, 30), summary={"my_rows": "2"})
    h = delete_where(h, "id >= 28")
    assert read_at(h).count() == 28
    assert snapshots(h).where("snapshot_id = 2").first()["summary"]["my_rows"] == "2"


def scans(spark, work):
    """Files that a change reads of the table, as often as it reads them."""
    seen, real = [], history.History.scan

    def counted(self, *args, **kw):
        seen.append(args)
        return real(self, *args, **kw)

    history.History.scan = counted
    try:
        work()
    finally:
        history.History.scan = real
    return len(seen)


def test_a_change_plans_one_scan_of_the_table(spark, path):
    h = make(spark, path, [(i, i) for i in range(20)], "id long, v long", key=["id"])
    assert scans(spark, lambda: delete_where(h, "id < 5")) == 1
    h = load_history(spark, path)
    assert scans(spark, lambda: update_where(h, {"v": "v + 1"}, "id < 9")) == 1


@pytest.mark.parametrize("name", ["_row_id", "_Added_In", "_old_x"])
def test_names_of_own_columns_are_refused(spark, path, name):
    with pytest.raises(ValueError, match="reserved"):
        make(spark, path, [(1,)], f"{name} long")
    h = make(spark, path, [(1,)], "id long")
    with pytest.raises(ValueError, match="reserved"):
        rename_column(h, "id", name)
    with pytest.raises(ValueError, match="reserved"):
        add_column(h, name, "int")


def test_values_that_would_not_survive_are_refused(spark, path):
    h = make(spark, path, [(1, 1.0)], "id long, x float")
    with pytest.raises(ValueError, match="cannot write"):
        append(h, spark.createDataFrame([(2.7, 1.0)], "id double, x float"))
    with pytest.raises(ValueError, match="cannot write"):
        append(h, spark.createDataFrame([(2, 0.1)], "id long, x double"))


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_a_large_source_passes_through_the_key_filter(spark, path, monkeypatch, words):
    monkeypatch.setattr(changes, "MAX_BROADCAST_KEYS", 0)
    monkeypatch.setattr(changes, "FILTER_WORDS", words)  # one word: every slot is taken, nothing may be lost
    df = spark.range(2000).selectExpr("cast(id as int) as a", "if(id % 10 = 0, null, concat('k', id)) as b", "id as x")
    h = create_history(df, path, key=["a", "b"])
    src = spark.range(1500, 2500).selectExpr("id as a", "concat('k', id) as b", "if(id % 2 = 0, id, -id) as x").where("a % 10 > 0")
    h, counts = upsert(h, src.select(F.col("a").cast("int"), "b", "x"))
    assert counts == UpsertCounts(inserted=450, updated=250, unchanged=200)
    want = df.join(src, ["a", "b"], "left_anti").union(src)
    assert rows(read_at(h)) == rows(want)
