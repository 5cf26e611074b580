import glob
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import snapshots as snap
from tidemark.operators.snapshots import read_at
from tidemark.operators.maintenance import compact, expire
from tidemark.operators.writes import append, ensure_history, load_history
from tidemark.sources.readers import read_stream
from tidemark.streaming import ingest
from tidemark.streaming.ingest import distribute, stream_append, to_sightings

SCHEMA = "character string not null, location string not null, event_time timestamp not null"


@pytest.fixture
def arriving(spark, tmp_path):
    def put(n, first):
        spark.range(first, first + n, 1, 1).selectExpr(
            "concat('c', id % 5) as who", "'shire' as place", "timestamp'2020-01-01' + make_interval(0,0,0,0,id) as at"
        ).write.mode("append").parquet(str(tmp_path / "in"))

    put(10, 0)
    put(10, 10)
    stream = read_stream(spark, str(tmp_path / "in"), "who string, place string, at timestamp", max_files=1)
    return to_sightings(stream, "who", "place", "at"), put


def run(stream, h, checkpoint, **kw):
    kw = {"key": "character", "interval_ms": None, **kw}
    q = stream_append(stream, h, checkpoint, **kw)
    q.awaitTermination()


def test_append_restart_and_query(spark, arriving, path, tmp_path):
    stream, put = arriving
    checkpoint = str(tmp_path / "checkpoint")
    run(stream, ensure_history(spark, path, SCHEMA), checkpoint)
    h = load_history(spark, path)
    assert read_at(h).count() == 20 and len(h.commits) == 2
    assert [c.summary["batch_id"] for c in h.commits.values()] == ["0", "1"]
    put(7, 20)
    run(stream, h, checkpoint)
    h = load_history(spark, path)
    assert read_at(h).count() == read_at(h).distinct().count() == 27 and len(h.commits) == 3
    assert read_at(h, snapshot_id=1).count() == 10  # readers see whole batches only


def test_a_batch_delivered_twice_is_appended_once(spark, arriving, path, tmp_path):
    stream, _ = arriving
    run(stream, ensure_history(spark, path, SCHEMA), str(tmp_path / "c1"))
    # The checkpoint is lost, so both batches come again under their old ids.
    run(stream, load_history(spark, path), str(tmp_path / "c2"))
    assert read_at(load_history(spark, path)).count() == 20
    run(stream, load_history(spark, path), str(tmp_path / "c3"), stream_id="another stream")
    assert read_at(load_history(spark, path)).count() == 40


def test_a_batch_that_failed_half_way_is_repeated(spark, arriving, path, tmp_path, monkeypatch):
    stream, _ = arriving
    h = ensure_history(spark, path, SCHEMA)
    real, calls = ingest.append, []

    def failing(h, df, **kw):
        calls.append(1)
        if len(calls) == 2:
            h.write_rows(h.next_snapshot_id, df)  # files are there, the commit is not
            raise RuntimeError("lost")
        return real(h, df, **kw)

    monkeypatch.setattr(ingest, "append", failing)
    with pytest.raises(Exception, match="lost"):
        run(stream, h, str(tmp_path / "c"))
    assert read_at(load_history(spark, path)).count() == 10
    run(stream, load_history(spark, path), str(tmp_path / "c"))
    h = load_history(spark, path)
    assert read_at(h).count() == read_at(h).distinct().count() == 20


def test_stream_to_a_branch(spark, arriving, path, tmp_path):
    stream, _ = arriving
    run(stream, ensure_history(spark, path, SCHEMA), str(tmp_path / "c"))
    h = snap.create_branch(load_history(spark, path), "live")
    run(stream, h, str(tmp_path / "d"), stream_id="second", branch="live")
    h = load_history(spark, path)
    assert (read_at(h).count(), read_at(h, branch="live").count()) == (20, 40)


def test_interval_trigger(spark, arriving, path, tmp_path):
    stream, _ = arriving
    q = stream_append(stream, ensure_history(spark, path, SCHEMA), str(tmp_path / "c"), interval_ms=100)
    try:
        q.processAllAvailable()
        assert read_at(load_history(spark, path)).count() == 20
    finally:
        q.stop()


def test_each_batch_writes_with_fixed_parallelism(spark, arriving, path, tmp_path):
    stream, _ = arriving
    run(stream, ensure_history(spark, path, SCHEMA), str(tmp_path / "c"), key=None)
    h = load_history(spark, path)
    assert len(glob.glob(f"{h.rows_path(1)}/*.parquet")) == 2


def test_required_column_stops_the_stream(spark, tmp_path, path):
    spark.sql("select 'a' as who, cast(null as string) as place, timestamp'2020-01-01' as at").write.parquet(
        str(tmp_path / "bad"))
    stream = read_stream(spark, str(tmp_path / "bad"), "who string, place string, at timestamp")
    with pytest.raises(Exception, match="NULL in required column location"):
        run(to_sightings(stream, "who", "place", "at"), ensure_history(spark, path, SCHEMA), str(tmp_path / "c"))


def test_distribution_keeps_keys_together_but_spreads_hot_ones(spark):
    df = spark.range(0, 10_000, 1, 4).select(
        "id", F.when(F.col("id") < 6000, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("k"))
    placed = distribute(df, 4, "k").withColumn("p", F.spark_partition_id())
    assert placed.rdd.getNumPartitions() == 4
    per_key = {r["k"]: r["n"] for r in placed.groupBy("k").agg(F.countDistinct("p").alias("n")).collect()}
    assert per_key.pop("hot") > 1 and set(per_key.values()) == {1}
    sizes = [r["count"] for r in placed.groupBy("p").count().collect()]
    assert sum(sizes) == 10_000


def test_stream_goes_on_beside_maintenance(spark, path, tmp_path, arriving, monkeypatch):
    """Compaction and another writer commit between the micro-batches of a running stream."""
    stream, _ = arriving
    h = ensure_history(spark, path, SCHEMA)
    real, beside = ingest.distribute, []

    def overtaken(*args, **kw):
        now = load_history(spark, path)
        if now.head() is not None and len(beside) < 2:
            now, _ = compact(now, 1 << 20)
            beside.append(append(now, spark.sql("select 'x' as character, 'y' as location, timestamp'2020-01-01' as event_time")))
        return real(*args, **kw)

    monkeypatch.setattr(ingest, "distribute", overtaken)
    query = stream_append(stream, h, str(tmp_path / "checkpoint"), interval_ms=None)
    query.awaitTermination(120)
    assert query.exception() is None and beside
    now, _ = expire(load_history(spark, path), older_than=datetime.now(timezone.utc))
    assert read_at(now).count() == 20 + len(beside)
    assert read_at(now).where("character <> 'x'").distinct().count() == 20
