import json
import glob

import pytest

from conftest import rows
from tidemark.sources import views
from tidemark.sources.readers import read_json_array, read_parquet, scan, union_all
from tidemark.sources.sinks import write_json_arrays


def test_json_array_files(spark, tmp_path):
    one = tmp_path / "permits.json"
    one.write_text(json.dumps([{"borough": "Queens", "n": 1}, {"borough": None, "n": 2}], indent=2))
    df = read_json_array(spark, str(one))
    assert rows(df.select("borough", "n")) == [("Queens", 1), (None, 2)]
    assert df.schema["n"].dataType.simpleString() == "bigint"
    assert read_json_array(spark, str(one), schema="borough string, n int").schema["n"].dataType.simpleString() == "int"


def test_json_arrays_round_trip(spark, tmp_path):
    df = spark.range(0, 25_000, 1, 3).selectExpr("id", "concat('a\"b\\n', id) as s")
    write_json_arrays(df, str(tmp_path / "j"))
    files = glob.glob(str(tmp_path / "j" / "*.txt"))
    assert len(files) == 3 and sum(len(json.load(open(f))) for f in files) == 25_000
    assert read_json_array(spark, str(tmp_path / "j")).select("id", "s").exceptAll(df).count() == 0
    write_json_arrays(df.limit(0), str(tmp_path / "empty"))
    assert read_json_array(spark, str(tmp_path / "empty"), schema="id long").count() == 0


def test_scan_and_union(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 as twice").write.parquet(str(tmp_path / "p"))
    df = read_parquet(spark, str(tmp_path / "p"))
    assert rows(scan(df, "id > 7", ["twice"])) == [(16,), (18,)]
    assert scan(df).count() == 10
    assert union_all(df, df, df).count() == 30


@pytest.fixture
def trips(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS nyc_test")
    spark.sql("DROP TABLE IF EXISTS nyc_test.trips")
    spark.createDataFrame([(1, 40.0, 5.0), (2, 3.0, -1.0)], "vendor long, distance double, total double") \
        .write.saveAsTable("nyc_test.trips")
    yield "nyc_test.trips"
    spark.sql("DROP TABLE nyc_test.trips")


def test_views(spark, trips):
    name = "nyc_test.long_trips"
    views.drop_view(spark, name)
    views.drop_view(spark, "nyc_test.negative_amounts")
    query = f"SELECT vendor, distance FROM {trips} WHERE distance > 35 ORDER BY distance"
    views.create_view(spark, name, query, [("vendor_id", "It's the vendor"), "distance"])
    assert rows(spark.table(name)) == [(1, 40.0)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        views.create_view(spark, name, query)
    views.create_view(spark, name, f"SELECT distance, total, vendor FROM {trips} WHERE distance > 2",
                      [("distance", "Miles"), "total", "vendor_id"], replace=True)
    assert rows(spark.table(name)) == [(3.0, -1.0, 2), (40.0, 5.0, 1)]
    spark.createDataFrame([(3, 50.0, 1.0)], "vendor long, distance double, total double").write.insertInto(trips)
    assert spark.table(name).count() == 3
    views.create_view(spark, "nyc_test.negative_amounts", f"SELECT * FROM {trips} WHERE total < 0")
    kept = views.show_views(spark, "nyc_test").where("not isTemporary")
    assert {r["viewName"] for r in kept.collect()} == {
        "long_trips", "negative_amounts"
    }
    assert [r["viewName"] for r in views.show_views(spark, "nyc_test", "*neg*").collect()] == ["negative_amounts"]
    described = {r["col_name"]: r["comment"] for r in views.describe_view(spark, name).collect()}
    assert described == {"distance": "Miles", "total": None, "vendor_id": None}
    assert "CREATE VIEW" in views.create_statement(spark, name)
    views.set_view_properties(spark, name, {"key1": "val1", "key2": "val2", "comment": "This is a view comment"})
    assert views.view_properties(spark, name)["key1"] == "val1"
    extended = {r["col_name"]: r["data_type"] for r in views.describe_view(spark, name, extended=True).collect()}
    assert extended["Comment"] == "This is a view comment"
    views.unset_view_properties(spark, name, "key1")
    left = views.view_properties(spark, name)
    assert "key1" not in left and left["key2"] == "val2"
    views.drop_view(spark, name)
    views.drop_view(spark, name)
    assert not spark.catalog.tableExists(name)


def test_tables_and_properties(spark, trips):
    assert spark.catalog.tableExists(trips) and not spark.catalog.tableExists("nyc_test.nope")
    spark.sql(f"ALTER TABLE {trips} SET TBLPROPERTIES ('write.wap.enabled'='true')")
    spark.sql(f"ALTER TABLE {trips} UNSET TBLPROPERTIES ('write.wap.enabled')")
    assert rows(spark.sql(f"SELECT count(*) FROM {trips}")) == [(2,)]


def test_namespaces_and_tables_are_sparks_own(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS nyc_ddl")
    spark.sql("DROP TABLE IF EXISTS nyc_ddl.taxis")
    spark.sql("""
        CREATE TABLE nyc_ddl.taxis (vendor bigint, pickup timestamp, total double, day date)
        USING parquet PARTITIONED BY (day) TBLPROPERTIES ('owner.team'='rides')
    """)
    spark.sql("INSERT INTO nyc_ddl.taxis VALUES (1, timestamp'2022-01-01 10:00:00', 3.5, date'2022-01-01')")
    assert rows(spark.table("nyc_ddl.taxis").select("vendor", "total")) == [(1, 3.5)]
    properties = {r["key"] for r in spark.sql("SHOW TBLPROPERTIES nyc_ddl.taxis").collect()}
    assert "owner.team" in properties
    spark.sql("DROP TABLE nyc_ddl.taxis")
    spark.sql("DROP DATABASE nyc_ddl CASCADE")


def test_public_names(spark, path):
    import tidemark

    h = tidemark.create_history(spark.range(5), path)
    tidemark.register_view(h, "numbers")
    assert spark.sql("SELECT count(*) AS n FROM numbers").first()["n"] == 5
    assert callable(tidemark.scan) and "History" in tidemark.__all__
