"""Work on single files of a history: compaction of some, gathered bounds, reads that skip files, bit words."""

import glob
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import stats as stats_of
from tidemark.operators.changes import delete_partition, delete_where, update_where
from tidemark.operators.evolve import add_column, rename_column, retype_column
from tidemark.operators.maintenance import cluster_by, compact, expire, read_range, set_partition_spec, stored_rows
from tidemark.operators.snapshots import cherrypick, create_branch, enable_wap, read_at
from tidemark.operators.stats import file_stats, gather_stats, partition_stats
from tidemark.operators.writes import append, create_history, load_history
from tidemark.plans import removals
from tidemark.plans.history import History

LATER = datetime(2100, 1, 1, tzinfo=timezone.utc)


def files_read(df):
    """Files that the scans of a fresh frame open when it runs."""
    df.collect()

    def walk(plan):
        n = plan.metrics().apply("numFiles").value() if plan.metrics().contains("numFiles") else 0
        children = plan.children()
        if plan.nodeName() == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in plan.nodeName():
            return walk(plan.plan())
        return n + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def good_files(spark, path, n=8):
    """n files of equal size, and a target that they fit."""
    df = spark.range(0, n * 500, 1, n).withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
    h = create_history(df, path)
    size = max(len(open(f, "rb").read()) for f in glob.glob(f"{h.rows_path(1)}/*.parquet"))
    return h, int(size * 1.1)


def test_one_removed_row_rewrites_one_file(spark, path):
    h, target = good_files(spark, path)
    h = delete_where(h, "id = 700")
    new, counts = compact(h, target)
    assert (counts.files_before, counts.files_after, counts.files_rewritten, counts.batches_rewritten) == (8, 8, 1, 1)
    seen = new.visible(new.head())
    assert seen.batches == [1, 3] and seen.partial == {1: [3]}
    assert not any(new.removals_of(seen).values()) and "Join" not in read_at(new)._jdf.queryExecution().toString()
    assert rows(read_at(new)) == rows(read_at(h)) and read_at(new, snapshot_id=1).count() == 4000
    assert files_read(read_at(new)) == 8
    assert compact(new, target)[0] is new
    assert rows(read_at(load_history(spark, path))) == rows(read_at(h))


def test_changes_after_a_partial_compaction(spark, path):
    h, target = good_files(spark, path)
    h = enable_wap(delete_where(h, "id in (700, 3000)"))
    staged = delete_where(h, "id = 701", wap_id="w")
    h, counts = compact(staged, target)
    assert counts.files_rewritten == 2
    h = cherrypick(h, 3)  # a row that was moved to another file meanwhile
    assert read_at(h).count() == 3997 and read_at(h).where("id in (700, 701, 3000)").count() == 0
    h, target = good_files(spark, path + "2")
    h = delete_where(enable_wap(h), "id = 701", wap_id="w")
    h, _ = compact(delete_where(h, "id = 701"), target)
    with pytest.raises(ValueError, match="conflict"):
        cherrypick(h, 2)


def test_update_compact_again_and_expire(spark, path):
    h, target = good_files(spark, path)
    h = create_branch(h, "b")
    h = update_where(h, {"pad": "'x'"}, "id between 600 and 610")
    h, counts = compact(h, target)
    assert counts.files_rewritten == 2  # the file with the old rows and the small one with the new
    h = delete_where(h, "id = 605 or id = 2100")
    h, counts = compact(h, target)
    assert counts.files_rewritten == 2
    want = rows(read_at(h))
    assert len(want) == 3998 and read_at(h, branch="b").where("pad = 'x'").count() == 0
    before = len(glob.glob(f"{h.path}/rows/**/*.parquet", recursive=True))
    kept, _ = expire(h, LATER)
    assert rows(read_at(kept, branch="b")) == rows(read_at(h, branch="b"))  # the branch still needs the first files
    assert len(glob.glob(f"{h.path}/rows/spec=0/batch=1/**/*.parquet", recursive=True)) == 8 <= before
    from tidemark.operators.snapshots import drop_branch

    alone, _ = expire(drop_branch(kept, "b"), LATER)
    assert len(glob.glob(f"{h.path}/rows/spec=0/batch=1/**/*.parquet", recursive=True)) == 6
    assert rows(read_at(alone)) == want and stored_rows(alone).count() == 3998


def test_partition_values_with_odd_names(spark, path):
    df = spark.createDataFrame([(i, k) for i in range(60) for k in ("a b", "c:d/ü", "100%", "")], "id int, k string")
    h = create_history(df, path, spec=[("identity", "k")])
    h, _ = compact(delete_where(h, "id = 3 and k = 'c:d/ü'"), 900)
    assert rows(read_at(h)) == rows(df.where("not (id = 3 and k = 'c:d/ü')"))
    h, _ = expire(h, LATER)
    assert rows(read_at(h)) == rows(df.where("not (id = 3 and k = 'c:d/ü')"))
    assert stored_rows(h).count() == 239


def test_only_small_files_that_can_be_joined_are_packed(spark, path):
    h, target = good_files(spark, path, 4)
    h = append(h, spark.range(4000, 4010, 1, 1).withColumn("pad", F.lit("p")))
    assert compact(h, target)[0] is h  # one small file alone
    h = append(h, spark.range(4010, 4020, 1, 1).withColumn("pad", F.lit("p")))
    h, counts = compact(h, target)
    assert (counts.files_before, counts.files_after, counts.files_rewritten) == (6, 5, 2)
    assert sorted(h.visible(h.head()).batches) == [1, 4] and read_at(h).count() == 2020


# -- gathered bounds ------------------------------------------------------------------------------


def without_path(df):
    return rows(df.drop("file_path", "file_size_in_bytes"))


@pytest.fixture
def mixed(spark, path):
    df = spark.createDataFrame(
        [(1, "b", None, [1], {"k": 1}), (2, None, 2.5, None, None), (3, "a", float("nan"), [0, 2], {})],
        "id int, s string, x double, a array<int>, m map<string,int>")
    return create_history(df.repartitionByRange(2, "id"), path)


def test_gathered_stats_equal_scanned_ones(spark, mixed):
    h = append(mixed, read_at(mixed).selectExpr("id + 10 as id", "s"))
    want = without_path(file_stats(h))
    gathered = gather_stats(h)
    assert without_path(file_stats(gathered)) == want
    h = append(gathered, read_at(mixed).selectExpr("id + 20 as id"))  # not gathered: scanned
    assert file_stats(h, ["id"]).count() == file_stats(gathered, ["id"]).count() + len(
        glob.glob(f"{h.rows_path(3)}/*.parquet"))
    h = gather_stats(h, always=True)
    h = delete_where(append(h, read_at(mixed).selectExpr("id + 30 as id")), "id = 31")
    assert stats_of._lacking(h, h.visible(h.head())) == []
    facts = file_stats(h).select("file_path", "file_size_in_bytes").distinct().collect()
    assert all(len(open(r[0].removeprefix("file:").replace("//", ""), "rb").read()) == r[1] for r in facts)
    assert load_history(spark, h.path).properties["gather_stats"] == "true"


def test_gathered_stats_read_no_data(spark, mixed):
    h = gather_stats(mixed)
    read = file_stats(h).inputFiles()
    assert read and all("/stats/" in f for f in read)
    assert any("/rows/" in f for f in file_stats(mixed.scan(0, [1])).inputFiles())


def test_stats_follow_the_schema(spark, mixed):
    h = gather_stats(mixed)
    h = retype_column(rename_column(add_column(h, "later", "string"), "id", "number"), "number", "long")
    found = {(r["column"], r["type"], r["null_count"], r["lower_bound"]) for r in file_stats(h).collect()}
    files = len(glob.glob(f"{h.rows_path(1)}/*.parquet"))
    assert ("number", "bigint", 0, "1") in found
    assert {r[2] for r in found if r[0] == "later"} <= {1, 2, 3} and files == file_stats(h, ["later"]).count()


def test_stats_after_partial_compaction(spark, path):
    h, target = good_files(spark, path)
    h = gather_stats(h, always=True)
    h, _ = compact(delete_where(h, "id = 700"), target)
    facts = file_stats(h, ["id"])
    assert facts.count() == 8 and facts.agg(F.sum("record_count")).first()[0] == 3999
    assert partition_stats(h).select("record_count", "file_count").first() == (3999, 8)
    assert stats_of._lacking(h, h.visible(h.head())) == []


# -- reads that skip files ------------------------------------------------------------------------


def shuffled(spark, n=4000):
    order = list(range(n))
    random.Random(1).shuffle(order)
    return spark.createDataFrame([(i, f"s{i:05}", i % 7) for i in order], "k int, s string, g int").repartition(6)


def test_a_range_opens_only_files_that_overlap(spark, path):
    df = spark.range(0, 100_000, 1, 4).selectExpr(
        "(id * 7919) % 100000 as k", "sha2(cast(id as string), 256) as s", "id % 7 as g")
    h = create_history(df.limit(0), path, properties={"target_file_bytes": str(1 << 20)})
    h = append(gather_stats(cluster_by(h, "k"), always=True), df)
    total = len(glob.glob(f"{h.rows_path(h.head())}/*.parquet"))
    assert total > 3
    assert sorted(r["k"] for r in read_range(h, "k", 100, 130).collect()) == list(range(100, 130))
    assert files_read(read_range(h, "k", 100, 130)) == 1
    assert files_read(read_range(h, "k", 500_000)) == 0 and read_range(h, "k").count() == 100_000
    assert files_read(read_range(h, "g", 3, 4)) == total  # nothing by which to skip
    assert read_range(h, "s", "0000", "00ff").where("s < '0000' or s >= '00ff'").count() == 0


def test_skipping_holds_through_changes(spark, path):
    h = gather_stats(cluster_by(create_history(shuffled(spark), path), "k"), always=True)
    h = append(h, shuffled(spark).selectExpr("k + 4000 as k", "s", "g"))
    h = append(h, spark.createDataFrame([(None, "none", 1), (50, "again", 1)], "k int, s string, g int"))
    h = update_where(h, {"k": "k + 1"}, "k = 60")
    h = delete_where(rename_column(h, "k", "key"), "key = 55")
    want = sorted([50] + [i for i in range(50, 70) if i not in (55, 60)] + [61])
    assert sorted(r["key"] for r in read_range(h, "key", 50, 70).collect()) == want
    h, _ = compact(h, 1 << 20)
    assert sorted(r["key"] for r in read_range(h, "key", 50, 70).collect()) == want
    old = read_range(h, "key", 50, 70, snapshot_id=1)
    assert sorted(r["key"] for r in old.collect()) == list(range(50, 70))
    h, _ = compact(cluster_by(h, "key"), 20_000)
    assert files_read(read_range(h, "key", 50, 70)) < len(glob.glob(f"{h.rows_path(h.head())}/*.parquet"))
    assert sorted(r["key"] for r in read_range(h, "key", 50, 70).collect()) == want


def test_clustering_needs_no_partitions(spark, path):
    h = cluster_by(create_history(shuffled(spark), path), "k")
    h = set_partition_spec(h, [("identity", "g")])
    h = append(h, shuffled(spark))
    assert read_at(h).count() == 8000
    assert cluster_by(h, None).cluster_field is None
    with pytest.raises(ValueError):
        cluster_by(h, "nope")


# -- bit words ------------------------------------------------------------------------------------


def test_words_hold_exactly_their_keys(spark):
    r = random.Random(5)
    keys = {(r.randrange(3), r.choice([0, 63, 64, 1 << 33, r.randrange(1 << 40)]) + r.randrange(70)) for _ in range(500)}
    df = spark.createDataFrame(sorted(keys), "_added_in long, _row_id long")
    words = removals.words_of(df)
    assert rows(removals.keys_of(words)) == rows(df)
    counts, n = removals.counted(words)
    assert sum(counts.values()) == len(keys) and n == words.count() < len(keys)
    around = df.selectExpr("_added_in", "explode(array(_row_id - 1, _row_id, _row_id + 1)) as _row_id").where("_row_id >= 0")
    left = {tuple(x) for x in removals.without(around, words.union(words)).collect()}
    assert left == {tuple(x) for x in around.collect()} - keys
    assert {tuple(x) for x in removals.listed_in(around, words).collect()} == keys


def test_a_mass_delete_is_listed_by_the_word(spark, path):
    h = create_history(spark.range(0, 100_000, 1, 4).withColumn("g", F.col("id") % 5), path)
    h = delete_where(h, "g < 4")
    c = h.commits[2]
    assert c.removed == {1: 80_000} and c.removed_words < 1700
    assert h.read_removals([2]).count() == c.removed_words
    assert read_at(h).count() == 20_000 and isinstance(load_history(spark, path), History)


# -- whole partitions -----------------------------------------------------------------------------


def daily(spark, path, **kw):
    df = spark.range(0, 240, 1, 4).selectExpr(
        "id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 6 as int), cast(id % 24 as int)) as ts",
        "if(id % 40 = 39, null, cast(id % 3 as int)) as g")
    return create_history(df, path, spec=[("day", "ts"), ("identity", "g")], **kw), df


def test_a_partition_goes_by_its_files(spark, path, monkeypatch):
    h, df = daily(spark, path)
    monkeypatch.setattr(History, "write_removals", None)  # no key is listed
    h = delete_partition(h, "day", "ts", "2024-01-03")
    want = df.where("to_date(ts) <> date'2024-01-03'")
    assert rows(read_at(h)) == rows(want) and h.commits[2].removed == {} and h.commits[2].removed_rows == 240 - want.count()
    h = delete_partition(h, "identity", "g", 1)
    h = delete_partition(h, "identity", "g", None)
    want = want.where("g <> 1")
    assert rows(read_at(h)) == rows(want) and h.commits[4].total_rows == want.count()
    h = delete_partition(h, "day", "ts", "2030-01-01")  # nothing there
    assert h.commits[5].removed_rows == 0
    assert read_at(h, snapshot_id=1).count() == 240
    files = len(glob.glob(f"{h.path}/rows/**/*.parquet", recursive=True))
    kept, _ = expire(h, LATER)
    assert rows(read_at(kept)) == rows(want) and stored_rows(kept).count() == want.count()
    assert len(glob.glob(f"{h.path}/rows/**/*.parquet", recursive=True)) < files
    with pytest.raises(ValueError):
        delete_partition(kept, "week", "ts", "2024-01-01")


def test_partitions_of_older_specs_and_removed_rows(spark, path):
    h, df = daily(spark, path)
    h = delete_where(h, "id = 2")
    h = append(set_partition_spec(h, [("hour", "ts")]), df.withColumn("id", F.col("id") + 1000))
    h = delete_partition(h, "day", "ts", "2024-01-03")
    want = df.where("id <> 2").union(df.withColumn("id", F.col("id") + 1000)).where("to_date(ts) <> date'2024-01-03'")
    assert rows(read_at(h)) == rows(want) and h.commits[4].total_rows == want.count()
    assert h.commits[4].dropped and set(h.commits[4].removed) == {3}
    h = delete_partition(h, "hour", "ts", "2024-01-02 07:00:00")
    want = want.where("date_trunc('hour', ts) <> timestamp_ntz'2024-01-02 07:00:00'")
    assert rows(read_at(h)) == rows(want)
    h, _ = compact(h, 1 << 20)
    assert rows(read_at(h)) == rows(want)


def test_text_partitions_tell_null_from_nothing(spark, path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "id int, k string")
    h = delete_partition(create_history(df, path, spec=[("identity", "k")]), "identity", "k", None)
    assert rows(read_at(h)) == [(1, ""), (3, "a b")]
    assert rows(read_at(delete_partition(h, "identity", "k", "a b"))) == [(1, "")]


def test_a_staged_partition_delete_is_picked_by_keys(spark, path):
    h, df = daily(spark, path)
    h = delete_partition(enable_wap(h), "day", "ts", "2024-01-03", wap_id="w")
    h = append(h, df.where("id < 30").withColumn("id", F.col("id") + 5000))  # main moves on, new rows of that day too
    h, _ = compact(h, 1 << 20)
    h = cherrypick(h, 2)
    want = df.where("to_date(ts) <> date'2024-01-03'").union(df.where("id < 30").withColumn("id", F.col("id") + 5000))
    assert rows(read_at(h)) == rows(want) and sum(h.commits[h.head()].removed.values()) == 40
    assert h.commits[h.head()].total_rows == want.count()
