"""Histories by name, and views over them that follow their commits in every session."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators.changes import delete_where, update_where, upsert
from tidemark.operators.evolve import add_column, comment_column, rename_column, retype_column
from tidemark.operators.maintenance import compact, expire, set_partition_spec
from tidemark.operators.snapshots import create_branch, drop_branch, fast_forward, read_at, rollback
from tidemark.operators.writes import (
    append, attach_history, create_history, detach_history, ensure_history, load_history, overwrite, refresh_names,
)
from tidemark.plans import names
from tidemark.sources.views import create_view

LATER = datetime(2100, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def ns(spark, tmp_path):
    name = f"n{abs(hash(str(tmp_path))) % 10**9}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def trips(spark, lo, hi):
    return spark.range(lo, hi, 1, 2).selectExpr("id", "cast(id % 3 as int) as g", "concat('v', id) as v")


def test_names_and_paths():
    assert names.is_name("t") and names.is_name("ns.t_1")
    for other in ("/tmp/t", "a/b", "s3://x/t", "a.b.c", "1t", "a-b", "", "ns.", "ns.t\n"):
        assert not names.is_name(other)


def test_create_append_and_load_by_name(spark, ns):
    h = create_history(trips(spark, 0, 10), f"{ns}.trips")
    assert spark.table(f"{ns}.trips").count() == 10
    h = append(load_history(spark, f"{ns}.trips"), trips(spark, 10, 15))
    assert spark.sql(f"SELECT count(*), max(v) FROM {ns}.TRIPS").first() == (15, "v9")
    assert load_history(spark, h.path).version == load_history(spark, f"{ns}.trips").version == h.version
    with pytest.raises(ValueError, match="exists already"):
        create_history(trips(spark, 0, 1), f"{ns}.trips")
    with pytest.raises(ValueError, match="no history named"):
        load_history(spark, f"{ns}.other")
    spark.sql(f"CREATE TABLE {ns}.plain (id long) USING parquet")
    with pytest.raises(ValueError, match="no history named"):
        load_history(spark, f"{ns}.plain")
    with pytest.raises(ValueError, match="exists already"):
        create_history(trips(spark, 0, 1), f"{ns}.plain")


def test_ensure_by_name_and_current_database(spark, ns):
    h = ensure_history(spark, f"{ns}.sightings", "id long not null, place string", spec=[("identity", "place")])
    assert spark.table(f"{ns}.sightings").columns == ["id", "place"] and spark.table(f"{ns}.sightings").count() == 0
    h = append(h, spark.createDataFrame([(1, "a b"), (2, None)], "id long, place string"))
    again = ensure_history(spark, f"{ns}.sightings", "ignored long")
    assert again.path == h.path and rows(spark.table(f"{ns}.sightings")) == [(1, "a b"), (2, None)]
    before = spark.catalog.currentDatabase()
    try:
        spark.catalog.setCurrentDatabase(ns)
        assert load_history(spark, "sightings").path == h.path
    finally:
        spark.catalog.setCurrentDatabase(before)


def test_every_kind_of_commit_shows(spark, ns):
    name = f"{ns}.trips"
    h = create_history(trips(spark, 0, 40), name, key=["id"])

    def check(h):
        assert rows(spark.table(name)) == rows(read_at(h)) and spark.table(name).columns == read_at(h).columns
        return h

    h = check(delete_where(h, "g = 1"))
    h = check(update_where(h, {"v": "'u'"}, "id < 5"))
    h = check(upsert(h, trips(spark, 38, 42))[0])
    h = check(rename_column(h, "v", "va lue.x"))
    h = check(add_column(h, "extra", "array<int>"))
    h = check(retype_column(h, "g", "long"))
    h = check(comment_column(h, "g", "it's a group"))
    assert "it's a group" in [r["comment"] for r in spark.sql(f"DESCRIBE {name}").collect()]
    h = check(set_partition_spec(h, [("identity", "g")]))
    h = check(append(h, read_at(h).where("id = 3").withColumn("id", F.lit(100).cast("long"))))
    h = check(delete_where(h, "id = 100 or id = 6"))
    size = 1500
    h = check(compact(h, size)[0])
    h = check(delete_where(h, "id = 9"))
    h = check(compact(h, size)[0])
    h = check(rollback(h, 2))
    h = check(overwrite(h, read_at(h).limit(3)))
    h = check(expire(h, LATER)[0])
    assert h.head() is not None and spark.table(name).count() == 3
    h = check(delete_where(h, "true"))


def test_a_view_follows_commits_in_another_session(spark, ns):
    h = create_history(trips(spark, 0, 100), f"{ns}.trips")
    create_view(spark, f"{ns}.long_trips", f"SELECT id, v FROM {ns}.trips WHERE id >= 50 ORDER BY id", ["trip", "label"])
    other = spark.newSession()
    assert other.table(f"{ns}.long_trips").count() == 50
    for n, lo in enumerate(range(100, 105)):
        h = append(h, trips(spark, lo, lo + 1))
        assert other.table(f"{ns}.long_trips").count() == 51 + n
    h = append(load_history(other, f"{ns}.trips"), trips(other, 200, 210))
    assert spark.table(f"{ns}.long_trips").count() == 65
    h = rename_column(h, "g", "grp")  # a column the view does not use
    assert other.table(f"{ns}.long_trips").columns == ["trip", "label"]
    assert other.table(f"{ns}.trips").columns == ["id", "grp", "v"]


def test_an_open_reader_survives_one_commit(spark, ns):
    h = create_history(trips(spark, 0, 10), f"{ns}.trips")
    open_plan = spark.table(f"{ns}.trips")
    append(h, trips(spark, 10, 20))
    assert open_plan.count() == 10 and spark.table(f"{ns}.trips").count() == 20


def test_old_file_tables_go(spark, ns):
    h = create_history(trips(spark, 0, 10), f"{ns}.trips")
    for i in range(4):
        h = append(h, trips(spark, 10 * i + 10, 10 * i + 20))
    prefix = names._tables_like(f"{ns}.trips")
    tables = spark.sql(f"SHOW TABLES IN {names.FILES_DATABASE} LIKE '{prefix}*'").collect()
    assert len(tables) == 2  # this version's and the one before


def test_branches_have_names(spark, ns):
    h = create_branch(create_history(trips(spark, 0, 10), f"{ns}.trips"), "audit")
    h = attach_history(h, f"{ns}.trips_audit", "audit")
    h = append(load_history(spark, f"{ns}.trips_audit"), trips(spark, 10, 12))  # its branch is the default
    assert spark.table(f"{ns}.trips").count() == 10 and spark.table(f"{ns}.trips_audit").count() == 12
    h = fast_forward(h, "main", "audit")
    assert spark.table(f"{ns}.trips").count() == 12
    with pytest.raises(ValueError, match="exists already"):
        attach_history(h, f"{ns}.trips")
    h = drop_branch(h, "audit")
    assert not spark.catalog.tableExists(f"{ns}.trips_audit") and spark.table(f"{ns}.trips").count() == 12


def test_attach_detach_and_refresh(spark, ns, path):
    h = attach_history(create_history(trips(spark, 0, 10), path), f"{ns}.late")
    assert spark.table(f"{ns}.late").count() == 10
    spark.sql(f"DROP VIEW {ns}.late")
    h = append(h, trips(spark, 10, 11))  # the name is gone from this catalog, which is left alone
    assert not spark.catalog.tableExists(f"{ns}.late")
    refresh_names(h)
    assert spark.table(f"{ns}.late").count() == 11
    spark.sql(f"DROP VIEW {ns}.late")
    spark.sql(f"CREATE TABLE {ns}.late (id long) USING parquet")
    h = append(h, trips(spark, 11, 12))  # another table has the name by now
    assert spark.table(f"{ns}.late").count() == 0 and read_at(h).count() == 12
    spark.sql(f"DROP TABLE {ns}.late")
    refresh_names(h)
    h = detach_history(h, f"{ns}.late")
    assert not spark.catalog.tableExists(f"{ns}.late") and load_history(spark, path).version == h.version
    append(h, trips(spark, 12, 13))
    assert not spark.catalog.tableExists(f"{ns}.late")
