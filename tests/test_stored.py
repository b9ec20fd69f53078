"""Keyed logs, run logs and the streams that write to them."""

import datetime as dt

import pytest
from frames import values
from pyspark.sql import functions as F

from gapspark.operators import classify, linear, reviews
from gapspark.plans.fixtures import PHRASES
from gapspark.sources import folders
from gapspark.sources.keyed_log import KeyedLog
from gapspark.sources.run_log import RunLog
from gapspark.streaming import reviews as ops

FILM = "film_link string, title string, score int"


def films(spark, *rows):
    return spark.createDataFrame(list(rows), FILM)


@pytest.fixture
def log(spark, tmp_path):
    made = KeyedLog(spark, str(tmp_path / "films"), "film_link", ["score"], buckets=4)
    made.start(films(spark, *[(f"m/{i}", f"t{i}", i) for i in range(200)]))
    return made


def test_known_values_win_over_nulls_and_first_titles_stay(spark, log):
    log.apply(films(spark, ("m/1", "new", 50), ("m/2", "new", None), ("m/900", "added", None), (None, "nobody", 1)), 0)
    log.apply(films(spark, ("m/1", "newer", None), ("m/900", "later", 7), (None, "nobody", 1)), 1)
    got = {r.film_link: (r.title, r.score) for r in log.read().collect() if r.film_link}
    assert (got["m/1"], got["m/2"], got["m/900"], len(got)) == (("t1", 50), ("t2", 2), ("added", 7), 201)
    assert log.read().where("film_link IS NULL").count() == 2


def test_repeats_and_compaction_change_nothing(spark, log):
    batches = [films(spark, ("m/1", "x", 10 * n), (f"m/{300 + n}", "x", n), (None, "n", n)) for n in range(4)]
    for n, batch in enumerate(batches):
        log.apply(batch, n)
        log.apply(batch, n)
    before = sorted(values(log.read()), key=str)
    assert log.compact() == 1 and log.compact() == 1 and log.batches() == []
    for n, batch in enumerate(batches):
        log.apply(batch, n)  # a stream that repeats what was folded in
    assert sorted(values(log.read()), key=str) == before
    log.apply(films(spark, ("m/1", "x", 99)), 4)
    assert log.compact() == 2
    assert log.read(keys=["m/1", "m/302", "none"]).orderBy("film_link").collect() == [("m/1", "t1", 99), ("m/302", "x", 2)]


def test_a_batch_writes_what_it_changes(spark, log):
    whole = folders.size(spark, f"{log.folder}/base")
    log.apply(films(spark, ("m/1", "x", 1)), 0)
    assert folders.size(spark, f"{log.folder}/log/batch=0") < whole / 3


def test_old_generations_go_and_broken_folds_are_not_seen(spark, log):
    for n in range(3):
        log.apply(films(spark, ("m/1", "x", 100 + n)), n)
        log.compact()
    assert folders.children(spark, f"{log.folder}/base") == ["generation=2", "generation=3"]
    assert folders.finished(spark, f"{log.folder}/log", "batch") == [2]
    films(spark, ("m/1", "broken", 0)).write.parquet(f"{log.folder}/base/generation=4/rows")
    assert log.read(keys=["m/1"]).first().score == 102
    log.apply(films(spark, ("m/1", "x", 200)), 3)
    assert log.compact() == 4 and log.read(keys=["m/1"]).first().score == 200


def test_reads_of_few_keys_open_few_buckets(spark, log, capsys):
    log.read(keys=["m/1"]).explain()
    assert "PartitionFilters: [_bucket" in capsys.readouterr().out.replace("isnotnull(_bucket", "[_bucket").replace("[[", "[")


def test_newest_row_replaces_the_older_one(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path), "film_link", overwrite=True)
    log.start(films(spark).limit(0))
    log.apply(films(spark, ("a", "x", 1), ("a", "y", 2)), 0, F.col("score"))
    assert values(log.read()) == [("a", "y", 2)]
    log.apply(films(spark, ("a", None, None)), 1)
    assert values(log.read()) == [("a", None, None)] and values(log.read(before=1)) == [("a", "y", 2)]
    with pytest.raises(FileNotFoundError):
        KeyedLog(spark, str(tmp_path / "none"), "film_link").read()


def test_sentiment_is_stored_once_per_review(spark, tmp_path):
    rows = [("m/1", "a", "1", PHRASES[0]), ("m/1", "a", None, PHRASES[1]), ("m/1", "a", None, PHRASES[1]),
            ("m/1", "a", None, PHRASES[2]), ("m/1", "a", "3", None), (None, None, None, PHRASES[1]), ("m/1", "a", "5", "")]
    reviews = spark.createDataFrame(rows, "film_link string, source string, external_id string, review_content string")
    models = linear.fit(spark.createDataFrame([(p, i % 2) for i, p in enumerate(PHRASES)], "text string, label int"))
    log = classify.sentiment_log(spark, str(tmp_path))
    for run in (0, 0, 1, 2, 1):
        classify.store_sentiment(log, reviews, models, run)
    assert log.read().count() == 4
    log.compact()
    classify.store_sentiment(log, reviews.unionAll(reviews), models, 3)
    stored = log.read()
    assert stored.count() == 4 and stored.where("fast_label IS NULL").count() == 0
    later = spark.createDataFrame([("m/2", "a", "1", PHRASES[4])], reviews.schema)
    classify.store_sentiment(log, reviews.unionAll(later), models, 4)
    assert log.read().count() == 5


def test_runs_take_a_partition_once(spark, tmp_path):
    landing = spark.createDataFrame([(m, i) for i, m in enumerate(["01", "01", "02", None, "03"])], "month string, n int")
    runs = RunLog(spark, str(tmp_path), "month")
    assert runs.taken() is None and runs.rows() is None
    assert runs.run(landing, lambda d: d, upto="01") == 0
    with pytest.raises(ZeroDivisionError):
        runs.run(landing, lambda d: 1 / 0)
    landing.write.parquet(f"{tmp_path}/rows/run=1")  # a run that broke before its commit
    assert sorted(r.n for r in runs.rows().collect()) == [0, 1]
    assert runs.run(landing, lambda d: d.where("n <> 4")) == 1
    assert runs.run(landing, lambda d: d) is None
    assert sorted(r.n for r in runs.rows().collect()) == [0, 1, 2, 3]
    assert sorted(((r.month or "", r.rows, r.run) for r in runs.taken().collect())) == [("", 1, 1), ("01", 2, 0), ("02", 1, 1), ("03", 0, 1)]
    more = landing.unionAll(spark.createDataFrame([("04", 9)], landing.schema))
    assert runs.run(more, lambda d: d) == 2 and runs.rows().count() == 5


# --- streams -----------------------------------------------------------------

ROW = "key string, id int, ts timestamp"


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.fixture
def landing(spark, tmp_path):
    path = str(tmp_path / "landing")

    def put(*rows):
        spark.createDataFrame(list(rows), ROW).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return ops.read_parquet_stream(spark, path, spark.createDataFrame([], ROW).schema, files=1)

    return put, stream, path


def test_bursts_over_batches_and_restarts(spark, landing, tmp_path):
    put, stream, path = landing

    def go():
        found = ops.first_of_bursts(stream(), "ts", ["key"], ["id"], "6 hours")
        writer = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        writer.trigger(availableNow=True).start(str(tmp_path / "rows")).awaitTermination()

    put(("a", 2, at(1)), ("a", 1, at(1)), ("b", 3, at(2)))
    put(("a", 4, at(6)), ("b", 5, at(8)))
    go()
    put(("a", 6, at(11)), ("b", 7, at(30)))  # the first run's state is read again
    go()
    put(("a", 8, at(40)))
    ops.close_landing(spark, path, spark.createDataFrame([], ROW).schema, ts=ops.CLOSING, key="")
    go()
    got = spark.read.parquet(str(tmp_path / "rows")).where("key <> ''")
    # 2 + 6 hours = 8: a pause as long as the delay still joins; 11 joins 6, 30 does not join 8
    assert sorted(values(got.select("key", "id", "copies"))) == [("a", 1, 4), ("a", 8, 1), ("b", 3, 2), ("b", 7, 1)]


def test_late_rows_are_counted_in_full(spark, landing, tmp_path):
    put, stream, path = landing
    for n in range(25):
        put(("a", n, at(n * 24)), ("a", 1000 + n, at(0)))
    query = ops.late_split(stream(), "ts", str(tmp_path / "split"), str(tmp_path / "state"), "36 hours")
    query.awaitTermination()
    counts = ops.late_counts(spark, str(tmp_path / "split"))
    assert counts.count() == 25
    # batch n starts at a watermark of day n - 1 less 36 hours: day 0 is late from batch 3 on
    assert counts.agg(F.sum("rows"), F.sum("late")).first() == (50, 22)
    rows = spark.read.parquet(str(tmp_path / "split" / "rows"))
    assert rows.where("late = 'true'").count() == 22 and rows.where("late = 'true' AND id < 1000").count() == 0


def test_index_is_swapped_between_batches_and_joined_once(spark, tmp_path, capsys):
    titles = spark.createDataFrame([("1", "Dune"), ("2", "Dune: Part Two"), ("3", "Heat"), ("4", ""), ("5", None)], "external_id string, film_title string")
    films_ = spark.createDataFrame([("m/d", "DUNE"), ("m/h", "heat"), ("m/h2", "Heat")], "film_link string, movie_title string")
    index = ops.TitleIndex(spark, str(tmp_path / "index"))
    index.publish(films_.where("film_link = 'm/d'"))
    path = str(tmp_path / "landing")

    def go():
        titles.coalesce(1).write.mode("append").parquet(path)
        stream = ops.read_parquet_stream(spark, path, titles.schema, files=1)
        ops.link_batches(stream, index, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.batch, r.external_id, r.film_link) for r in spark.read.parquet(str(tmp_path / "rows")).collect())

    assert go() == [(0, "1", "m/d"), (0, "2", "m/d")]
    assert index.publish(films_) == 1
    assert go()[2:] == [(1, "1", "m/d"), (1, "2", "m/d"), (1, "3", "m/h")]
    found = ops.link_by_index(titles, index.newest())
    capsys.readouterr()
    found.explain()
    shown = capsys.readouterr().out
    # one join with the index; the other brings the answers back to the articles
    assert shown.count("ReadSchema: struct<title_key:string,film_link:string>") == 1


def test_sketches_of_disjoint_parts_merge_within_their_error(spark):
    rows = spark.range(60_000).selectExpr(
        "concat('m/', id * 7 % 20000) AS film_link", "if(id % 3 = 0, 'a', 'b') AS source", "date_format(date_add(DATE'2020-01-01', int(id % 300)), 'yyyy-MM') AS month")
    rows = rows.unionByName(spark.createDataFrame([(None, "a", "2020-05"), ("m/1", None, "2020-05"), ("m/2", "a", None)], "film_link string, source string, month string"))
    parts = [reviews.review_sketches(rows.where(x)) for x in ("month < '2020-04'", "month >= '2020-04' OR month IS NULL")]
    got = values(reviews.sketched_load_stats(parts[0].unionByName(parts[1]), "2020-03", ("a", "b", "c")))[0]
    recent = rows.where("month >= '2020-03' AND source IN ('a', 'b')")
    films = recent.select("film_link").where("film_link IS NOT NULL").distinct().count()
    assert got[:3] == (recent.where("source = 'a'").count(), recent.where("source = 'b'").count(), 0)
    assert films > 10_000 and abs(got[3] - films) <= reviews.sketch_error() * films
    assert values(reviews.sketched_load_stats(parts[0].limit(0), "2020-03", ("a",))) == [(0, 0)]
