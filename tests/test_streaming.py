"""Streams fed file by file, compared with the batch operators."""

import datetime as dt

import pytest
from frames import values
from pyspark.sql import functions as F

from gapspark import session
from gapspark.plans.fixtures import Views
from gapspark.streaming import lifecycle, reviews as ops


@pytest.fixture
def landing(spark, tmp_path):
    """A function that writes one file of reviews; and the stream over all of them."""
    path = str(tmp_path / "landing")
    schema = "film_link string, source string, external_id string, review_type string, ts timestamp"

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return ops.read_parquet_stream(spark, path, schema, files=1)

    return put, stream


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_duplicates_across_batches(spark, landing):
    put, stream = landing
    put(("m/1", "a", "1", "Fresh", at(0)), ("m/1", "a", "1", "Fresh", at(0)))
    put(("m/1", "a", "1", "Fresh", at(0, 5)), ("m/1", "b", "1", "Fresh", at(0)))
    rows, _ = ops.run_to_table(spark, ops.dedupe(stream(), "ts"), "dedupe")
    assert sorted(values(spark.read.parquet(rows).select("source", "external_id"))) == [
        ("a", "1"), ("b", "1"),
    ]


def test_duplicates_across_batches_without_a_state_store(spark, landing, tmp_path):
    put, stream = landing
    put(("m/1", "a", "1", "Fresh", at(0, 5)), ("m/2", "a", "1", "Fresh", at(0)), ("m/1", None, "1", "Fresh", at(0)))
    folder, state = str(tmp_path / "kept"), str(tmp_path / "kept-state")

    def run():
        query = ops.dedupe_batches(stream(), "ts", folder, state)
        query.awaitTermination()
        assert not [o for p in query.recentProgress for o in p.stateOperators]
        return sorted(values(spark.read.parquet(folder).select("film_link", "external_id", "ts")), key=str)

    first = [("m/1", "1", at(0)), ("m/2", "1", at(0))]
    assert run() == first
    put(("m/3", "a", "1", "Fresh", at(1)), ("m/1", None, "1", "Fresh", at(0, 9)), ("m/3", "a", "2", "Fresh", at(1)))
    second = sorted([*first, ("m/3", "2", at(1))], key=str)
    assert run() == second  # the run goes on from its checkpoint
    put(("m/4", "a", "1", "Fresh", at(3)))  # beyond the delay
    assert run() == sorted([*second, ("m/4", "1", at(3))], key=str)


def test_late_rows_are_dropped_and_counted(spark, landing):
    put, stream = landing
    put(("m/1", "a", "1", "Fresh", at(0)), ("m/1", "a", "2", "Fresh", at(40)))
    put(("m/1", "a", "3", "Fresh", at(41)))  # late rows are judged by the batch before
    put(("m/1", "a", "4", "Rotten", at(1)))
    put(("m/1", "a", "5", "Fresh", at(80)))
    rows, query = ops.run_to_table(spark, ops.window_counts(stream(), "ts"), "windows")
    got = spark.read.parquet(rows)
    assert got.agg(F.sum("fresh_count"), F.sum("rotten_count")).first() == (3, 0)
    assert ops.late_rows(query) == 1


@pytest.mark.parametrize("slide", [None, "1 day"])
def test_windows_equal_the_batch_operator(spark, folder, tmp_path, slide):
    v = Views(spark, folder)
    dated = v.plain_reviews.withColumn("ts", ops.event_time(F.col("review_date")))
    path = str(tmp_path / "in")
    dated.repartition(3).write.parquet(path)
    stream = ops.read_parquet_stream(spark, path, dated.schema, files=1)
    counts = ops.window_counts(stream, "ts", slide=slide, delay="3000 days")
    base = session.fresh_path(spark, "complete")
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("windows")
        .option("checkpointLocation", base).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = ops.window_counts(dated, "ts", slide=slide, watermark=False)
    assert sorted(values(spark.table("windows"))) == sorted(values(batch))


def test_sessions_equal_the_batch_operator(spark, landing):
    put, stream = landing
    put(("m/1", "a", "1", "Fresh", at(0)), ("m/2", "a", "2", "Fresh", at(0)))
    put(("m/1", "a", "3", "Fresh", at(10)), ("m/1", "a", "4", "Fresh", at(30)))
    put(("m/3", "a", "5", "Fresh", at(100)))
    rows, _ = ops.run_to_table(
        spark, ops.activity_sessions(stream(), "ts", delay="20 days"), "sessions"
    )
    got = sorted(values(spark.read.parquet(rows)))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [
        ("m/1", at(0), at(24), 2), ("m/1", at(30), at(44), 1), ("m/2", at(0), at(14), 1),
    ]


def test_window_events_over_several_batches(spark, landing):
    put, stream = landing
    put(("m/1", "a", "1", "Fresh", at(0, 9)), ("m/1", "a", "2", "Fresh", at(0, 10)))
    put(("m/1", "a", "3", "Fresh", at(14)))
    put(("m/1", "a", "4", "Fresh", at(40)))
    put(("m/2", "a", "5", "Fresh", at(90)))
    with session.setting(spark, session.STATE_STORE, lifecycle.STATE_PROVIDER):
        events = lifecycle.window_events(lifecycle.review_days(stream(), "ts"))
        rows, _ = ops.run_to_table(spark, events, "events")
    got = sorted(values(spark.read.parquet(rows)), key=lambda r: (r[0], r[2]))
    assert got == [
        ("m/1", "opened", at(0).date()), ("m/1", "closed", at(29).date()),
        ("m/1", "opened", at(40).date()), ("m/1", "closed", at(55).date()),
    ]


def test_upsert_batches_can_be_repeated(spark, landing):
    put, stream = landing
    base = session.fresh_path(spark, "films")
    spark.createDataFrame([("m/1", "One", None)], "film_link string, title string, ts timestamp") \
        .write.parquet(f"{base}/0")
    put(("m/1", "a", "1", "Fresh", at(3)), ("m/1", "a", "2", "Fresh", at(5)))
    put(("m/1", "a", "3", "Fresh", at(4)), ("m/2", "a", "4", "Fresh", at(1)))
    apply = ops.snapshot_upsert(spark, base, "film_link", F.col("ts"), ["ts"])
    query = ops.upsert_batches(stream().select("film_link", "ts"), apply, f"{base}/state")
    query.awaitTermination()
    want = [("m/1", "One", at(4)), ("m/2", None, at(1))]
    assert values(spark.read.parquet(f"{base}/2").orderBy("film_link")) == want
    again = spark.createDataFrame([("m/1", at(4)), ("m/2", at(1))], "film_link string, ts timestamp")
    apply(again, 1)
    assert values(spark.read.parquet(f"{base}/2").orderBy("film_link")) == want
