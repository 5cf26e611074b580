import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows
from tidemark.operators import evolve
from tidemark.operators.changes import delete_where, update_where, upsert
from tidemark.operators.maintenance import set_partition_spec
from tidemark.operators.snapshots import read_at, rollback, set_properties, unset_properties
from tidemark.operators.writes import (
    add_derived, append, append_files, create_history, ensure_history, insert_positional, load_history, overwrite,
    reconcile,
)


@pytest.fixture
def h(spark, path):
    data = spark.createDataFrame([(1, 10.0, 2.0), (2, 10.0, 0.0)], "id int, fare_amount double, trip_distance double")
    return create_history(data, path)


def test_taxi_schema_walk_through(spark, h):
    h = evolve.rename_column(h, "fare_amount", "fare")
    h = evolve.rename_column(h, "trip_distance", "distance")
    h = evolve.comment_column(h, "distance", "Miles")
    h = evolve.retype_column(h, "distance", "double")
    h = evolve.move_column(h, "distance", after="fare")
    h = evolve.add_column(h, "fare_per_distance_unit", "float", after="distance")
    assert read_at(h).columns == ["id", "fare", "distance", "fare_per_distance_unit"]
    assert read_at(h).schema["distance"].metadata["comment"] == "Miles"
    h = update_where(h, {"fare_per_distance_unit": "try_divide(fare, distance)"})
    assert rows(read_at(h)) == [(1, 10.0, 2.0, 5.0), (2, 10.0, 0.0, None)]
    h = delete_where(h, "fare_per_distance_unit is null")
    h = rollback(h, 1)
    # data of the first snapshot, columns of now
    assert rows(read_at(h)) == [(1, 10.0, 2.0, None), (2, 10.0, 0.0, None)]
    assert read_at(load_history(spark, h.path)).schema == read_at(h).schema
    described = evolve.describe(h).orderBy("position").collect()
    assert [(r["col_name"], r["data_type"], r["comment"], r["field_id"]) for r in described] == [
        ("id", "int", None, 1), ("fare", "double", None, 2), ("distance", "double", "Miles", 3),
        ("fare_per_distance_unit", "float", None, 4),
    ]


def test_positions(h):
    h = evolve.move_column(h, "trip_distance", first=True)
    assert h.schema.names == ["trip_distance", "id", "fare_amount"]
    assert evolve.move_column(h, "id", after="fare_amount").schema.names == ["trip_distance", "fare_amount", "id"]


def test_add_first_or_last(h):
    h = evolve.add_column(h, "a", "string", first=True)
    h = evolve.add_column(h, "z", "array<string>", comment="last")
    assert h.schema.names == ["a", "id", "fare_amount", "trip_distance", "z"]
    assert rows(read_at(h).select("a", "z")) == [(None, None), (None, None)]


def test_a_freed_name_does_not_bring_old_values_back(spark, h):
    h = evolve.rename_column(h, "fare_amount", "old")
    h = evolve.add_column(h, "fare_amount", "double")
    assert rows(read_at(h).select("old", "fare_amount")) == [(10.0, None), (10.0, None)]


def test_widening_reads_old_files(spark, h):
    h = evolve.retype_column(h, "id", "bigint")
    h = append(h, spark.createDataFrame([(2**40, 1.0, 1.0)], "id long, fare_amount double, trip_distance double"))
    assert rows(read_at(h).select("id")) == [(1,), (1099511627776,), (2,)]
    assert read_at(h).where("id > 1").count() == 2


@pytest.mark.parametrize("name,dtype", [("id", "smallint"), ("fare_amount", "float"), ("id", "string")])
def test_narrowing_is_refused(h, name, dtype):
    with pytest.raises(ValueError, match="cannot change"):
        evolve.retype_column(h, name, dtype)


def test_unknown_and_taken_names(h):
    with pytest.raises(ValueError, match="no column"):
        evolve.rename_column(h, "nope", "x")
    with pytest.raises(ValueError, match="exists"):
        evolve.rename_column(h, "id", "FARE_AMOUNT")
    with pytest.raises(ValueError, match="exists"):
        evolve.add_column(h, "id", "int")
    with pytest.raises(ValueError, match="come after"):
        evolve.move_column(h, "id", after="nope")


def test_renaming_a_key_keeps_it_the_key(spark, path):
    h = create_history(spark.createDataFrame([(1, "a")], "k int, v string"), path, key=["k"])
    h = evolve.rename_column(h, "k", "id")
    h, counts = upsert(h, spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"))
    assert (counts.inserted, counts.updated) == (1, 1)


def test_union_schema(spark, h):
    wide = T.StructType.fromDDL("id bigint, fare_amount double, tip float")
    new = evolve.union_schema(h, wide)
    assert [(f.name, f.dataType.simpleString()) for f in new.schema] == [
        ("id", "bigint"), ("fare_amount", "double"), ("trip_distance", "double"), ("tip", "float")
    ]
    assert evolve.union_schema(new, wide) is new
    assert evolve.union_schema(new, T.StructType.fromDDL("id int")) is new  # narrower: nothing to do
    with pytest.raises(ValueError, match="differ"):
        evolve.union_schema(new, T.StructType.fromDDL("tip string"))


def test_write_with_unknown_column_fails_until_the_schema_has_it(spark, h):
    df = read_at(h).withColumn("tip_per_mile", F.lit(1.0))
    with pytest.raises(ValueError, match="tip_per_mile"):
        overwrite(h, df)
    with pytest.raises(ValueError, match="tip_per_mile"):
        append(h, df)
    h = overwrite(evolve.union_schema(h, df.schema), df)
    assert rows(read_at(h).select("tip_per_mile")) == [(1.0,), (1.0,)]


def test_write_with_wrong_type_fails(spark, h):
    with pytest.raises(ValueError, match="cannot write string"):
        append(h, spark.createDataFrame([("x",)], "id string"))
    with pytest.raises(ValueError, match="columns given"):
        insert_positional(h, spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(ValueError, match="cannot write string"):
        insert_positional(h, spark.createDataFrame([("x", 1.0, 1.0)], "a string, b double, c double"))


def test_number_out_of_range_fails_at_write(spark, h):
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        append(h, spark.createDataFrame([(2**40,)], "id long"))
    assert load_history(spark, h.path).head() == 1


def test_required_column(spark, path):
    h = ensure_history(spark, path, "id long not null, v string")
    with pytest.raises(ValueError, match="required but missing"):
        append(h, spark.createDataFrame([("x",)], "v string"))
    with pytest.raises(Exception, match="NULL in required column id"):
        append(h, spark.createDataFrame([(None, "x")], "id long, v string"))
    assert rows(read_at(append(h, spark.createDataFrame([(1,)], "id long")))) == [(1, None)]


def test_append_by_name_insert_by_position(spark, h):
    h = append(h, spark.createDataFrame([(7.0, 8.0, 3)], "trip_distance double, fare_amount double, id int"))
    h = insert_positional(h, spark.createDataFrame([(4, 8.0, 7.0)], "x int, trip_distance double, fare_amount double"))
    assert rows(read_at(h).where("id > 2")) == [(3, 8.0, 7.0), (4, 8.0, 7.0)]


def test_create_fails_where_a_history_exists(spark, h):
    with pytest.raises(ValueError, match="exists already"):
        create_history(read_at(h), h.path)


def test_append_files(spark, h, tmp_path):
    spark.createDataFrame([(5, 1.0, 1.0)], "id int, fare_amount double, trip_distance double").write.parquet(
        str(tmp_path / "extra")
    )
    assert read_at(append_files(h, str(tmp_path / "extra"))).count() == 3


def test_add_derived(spark, h):
    h = add_derived(h, "per_mile", "try_divide(fare_amount, trip_distance)")
    assert rows(read_at(h).select("id", "per_mile")) == [(1, 5.0), (2, None)]


def test_odd_column_names(spark, path):
    data = spark.createDataFrame([(1, "x")], "`a.b` int, `sp ace` string")
    h = create_history(data, path, key=["a.b"])
    h = update_where(h, {"sp ace": F.lit("y")}, "`a.b` = 1")
    h = set_partition_spec(h, [("identity", "sp ace")])
    h, _ = upsert(h, spark.createDataFrame([(1, "z"), (2, "w")], data.schema))
    assert rows(read_at(h)) == [(1, "z"), (2, "w")]


def test_nested_types(spark, path):
    ddl = "id int, stack array<string>, tags map<string,string>, at timestamp, n struct<x:int,y:string>"
    data = spark.sql("select 1 id, array('a','b') stack, map('k','v') tags, timestamp'2024-01-01' at, "
                     "named_struct('x', 1, 'y', 'q') n")
    h = append(ensure_history(spark, path, ddl), data)
    assert rows(read_at(h)) == rows(data)


def test_properties(h):
    h = set_properties(h, {"a": "1", "b": "2"})
    assert load_history(h.spark, h.path).properties == {"a": "1", "b": "2"}
    assert unset_properties(h, "a").properties == {"b": "2"}


def test_reconcile_counts_duplicates_and_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, s string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, s string")
    assert rows(reconcile(left, right)) == [(3, 3, 1, 1)]
    assert rows(reconcile(left, left)) == [(3, 3, 0, 0)]
    assert rows(reconcile(left.limit(0), left.limit(0))) == [(0, 0, 0, 0)]


def _different_buckets(df):
    """Rows that the exact part of a finished comparison shuffled."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("== Final Plan ==") : text.index("== Initial Plan ==")]


def test_reconcile_shuffles_rows_only_where_fingerprints_differ(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 4).selectExpr(
        "id", "if(id % 7 = 0, null, concat('s', id % 100)) as s", "if(id % 5 = 0, double('nan'), id / 3) as x",
        "array(id, null) as a", "if(id % 2 = 0, map('k', id, 'j', null), null) as m", "named_struct('p', null, 'q', id) as t")
    df.write.parquet(str(tmp_path / "a"))
    df.orderBy(F.desc("id")).write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    same = reconcile(a, b)
    assert "LeftSemi" not in _different_buckets(same) and rows(same) == [(20_000, 20_000, 0, 0)]
    changed = b.where("id <> 77").union(b.where("id = 5")).withColumn("s", F.when(F.col("id") != 9, F.col("s")))
    found = reconcile(a, changed)
    assert "LeftSemi" in _different_buckets(found) and rows(found) == [(20_000, 20_000, 2, 2)]
    assert rows(reconcile(a.unionAll(a), a)) == [(40_000, 20_000, 20_000, 0)]


def test_reconcile_types_and_nested_nulls(spark):
    left = spark.sql("select 1 as k, 0.0D as x, array(1, null) as a, cast(null as string) as s, 'n' as u")
    assert rows(reconcile(left, spark.sql("select 1L as k, -0.0D as x, array(1, null) as a, null as s, 'n' as u"))) == [(1, 1, 0, 0)]
    for other in ("array(null, 1) as a, null as s, 'n' as u", "array(1) as a, null as s, 'n' as u",
                  "array(1, null) as a, 'n' as s, null as u"):
        assert rows(reconcile(left, spark.sql(f"select 1 as k, 0.0D as x, {other}"))) == [(1, 1, 1, 1)]
    moments = "select timestamp_ntz'2024-01-01 00:00:00.00000{}' as ts, array(timestamp_ntz'2024-01-01 00:00:00.00000{}') as l"
    a, b = spark.sql(moments.format(1, 1)), spark.sql(moments.format(1, 2))
    assert rows(reconcile(a, a)) == [(1, 1, 0, 0)] and rows(reconcile(a, b)) == [(1, 1, 1, 1)]


def test_drop_column(spark, path):
    from tidemark.operators.evolve import add_column, drop_column

    h = create_history(spark.createDataFrame([(1, "a", 2.0)], "id int, s string, x double"), path, key=["id"],
                       spec=[("identity", "s")])
    for name in ("id", "s", "nope"):
        with pytest.raises(ValueError):
            drop_column(h, name)
    h = drop_column(h, "x")
    assert read_at(h).columns == ["id", "s"]
    h = add_column(h, "x", "string")
    assert rows(read_at(h)) == [(1, "a", None)] and rows(read_at(h, snapshot_id=1)) == [(1, "a", None)]
    only = create_history(spark.range(1), path + "2")
    with pytest.raises(ValueError, match="last column"):
        drop_column(only, "id")
