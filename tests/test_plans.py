"""What the physical plans of reads and changes look like."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.analytics import histogram, trim_outliers, zscore
from tidemark.operators.changes import _classified, delete_where, update_where
from tidemark.operators.maintenance import compact
from tidemark.operators.snapshots import read_at
from tidemark.operators.stats import file_stats
from tidemark.operators.writes import append, create_history
from tidemark.workloads import ORACLES, QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def h(spark, path):
    df = spark.range(0, 1000, 1, 2).selectExpr("id", "id % 7 as g", "cast(id as double) as x")
    h = create_history(df, path)
    return append(h, df.selectExpr("id + 1000 as id", "g", "x"))


def test_a_read_without_removals_is_a_plain_pruned_scan(h):
    text = plan(read_at(h).where("g = 3").select("id"))
    assert "Join" not in text and "Exchange" not in text and "Union" not in text
    assert "EqualTo(f2,3)" in text and "ReadSchema: struct<f1:bigint,f2:bigint>" in text


def test_only_batches_with_removals_are_joined_and_by_broadcast(h):
    h = delete_where(h, "id < 10")
    text = plan(read_at(h).select("id"))
    assert text.count("BroadcastHashJoin") == 1 and "LeftAnti" in text and "SortMergeJoin" not in text
    assert "Union" in text and "Exchange hashpartitioning" not in text


def test_full_updates_and_rewrites_leave_no_join(h):
    h = update_where(h, {"x": F.col("x") + 1})
    assert "Join" not in plan(read_at(h))
    h, _ = compact(delete_where(h, "id = 5"))
    assert "Join" not in plan(read_at(h))


def test_filters_reach_the_scan_through_the_removal_join(h):
    text = plan(read_at(delete_where(h, "id < 10")).where("g = 3"))
    assert text.count("EqualTo(f2,3)") == 2


def test_global_statistics_are_scalar_subqueries(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) as x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (zscore(df, "x"), trim_outliers(df, "x")):
        text = plan(out)
        assert "Subquery" in text and "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text
    text = plan(histogram(df, "x"))
    assert "Window" not in text and "NestedLoop" not in text and "Cartesian" not in text
    assert "NestedLoop" not in plan(file_stats(df))


def test_a_small_upsert_does_not_shuffle_the_table(spark, h):
    src = spark.createDataFrame([(1, 2, 3.0)], "id long, g long, x double")
    text = plan(_classified(h.live(h.head()), src, ["id"], h.schema, few=True))
    below = text[text.index("LeftSemi"):]
    assert "SortMergeJoin" not in below and "Exchange hashpartitioning" not in below
    assert below.count("FileScan parquet") == 1


def test_a_large_upsert_shuffles_the_table_once(spark, h, tmp_path):
    spark.range(500).selectExpr("id * 3 as id", "id as g", "1.0D as x").write.parquet(str(tmp_path / "src"))
    src = spark.read.parquet(str(tmp_path / "src"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, -1)
        text = plan(_classified(h.live(h.head()), src, ["id"], h.schema, few=False))
    finally:
        spark.conf.set(threshold, before)
    assert text.count("SortMergeJoin") == 2
    # the table once, the source (shared when run) twice, words of the key filter
    assert text.count("Exchange hashpartitioning") == 4
    table = text[text.index("SortMergeJoin", text.index("SortMergeJoin") + 1):]  # below the join with the keys
    assert table.index("Exchange hashpartitioning") < table.index("BroadcastHashJoin") < table.index("FileScan")


def test_the_key_filter_lets_few_others_through(spark):
    from tidemark.operators.changes import _may_match

    keys = spark.range(0, 30_000, 3).selectExpr("id as a", "concat('k', id) as b")
    rows = spark.range(300_000).selectExpr("id as a", "concat('k', id) as b", "id * 2 as x")
    passed = _may_match(rows, keys)
    assert passed.where("a < 30000 and a % 3 = 0").count() == 10_000 and passed.count() < 10_500
    text = plan(passed)
    assert "BroadcastHashJoin" in text and "Exchange" not in text[: text.index("BroadcastExchange")]


def test_no_python_in_changes_and_reads(h):
    h = delete_where(h, "id < 10")
    assert "Python" not in plan(read_at(h)) and "Pandas" not in plan(read_at(h))


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_overlapping_writes_restore_the_session(spark):
    from tidemark.plans.partitioning import session_settings

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    first, second = session_settings(spark, {name: "1000"}), session_settings(spark, {name: "2000"})
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(name) == "2000"
    second.__exit__(None, None, None)
    assert spark.conf.get(name) == before
