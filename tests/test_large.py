"""What keeps the work of large tables in bounds; results stay those of the plain operators."""

import contextlib
import datetime as dt
import io

import pytest
from frames import values
from pyspark.sql import functions as F

from gapspark import session
from gapspark.operators import aspects, classify, linear
from gapspark.plans.registry import load_all
from gapspark.sources import folders
from gapspark.streaming import lifecycle, reviews as ops


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_shared_aspects_equal_those_of_every_row(spark):
    texts = [None, "", "Short.", "The acting is superb here. A gripping plot, too!", "No keyword in here at all."]
    rows = [(i, texts[i % len(texts)]) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, body string")
    want = aspects.aspect_rows(df, "body").drop("body")
    assert sorted(values(aspects.shared_aspects(df, "body"))) == sorted(values(want))
    found = aspects.shared_aspects(df, "body", with_text=False, detected=True)
    assert sorted(values(found)) == sorted(values(want.where("detected").select("k", "aspect", "confidence")))


@pytest.mark.parametrize("name", ["aspect_detect", "aspect_sentences", "film_aspects"])
def test_sentences_are_not_cut_review_by_review(spark, folder, name):
    shown = plan(load_all()[name](spark, folder))
    assert "split(" not in shown


def test_a_part_lands_in_many_files_and_is_one_batch(spark, tmp_path):
    path, seen = str(tmp_path / "landing"), []
    rows = spark.range(0, 1000, 1, 4).selectExpr("id", "id % 2 AS part")
    folders.create(spark, path)
    stream = ops.read_parquet_stream(spark, path, rows.schema)

    def apply(batch, number) -> None:
        parts = [r[0] for r in batch.select("part").distinct().collect()]
        seen.append((parts, batch.count()))

    def run() -> None:
        ops.upsert_batches(stream, apply, str(tmp_path / "state")).awaitTermination()

    ops.land(rows, path, 2, F.col("part"), run)
    assert seen == [([0], 500), ([1], 500)]
    assert len(spark.read.parquet(path).inputFiles()) == 8


def test_films_of_one_bucket_close_on_their_own_days(spark, tmp_path):
    path, first = str(tmp_path / "landing"), dt.datetime(2024, 1, 1)
    base = session.fresh_path(spark, "events")
    folders.create(spark, path)
    stream = ops.read_parquet_stream(spark, path, "film_link string, ts timestamp")
    with session.setting(spark, session.STATE_STORE, lifecycle.STATE_PROVIDER):
        events = lifecycle.window_events(lifecycle.review_days(stream, "ts"), buckets=1)
        for batch in ([("a", 0), ("b", 3), ("c", 9)], [("a", 10), ("d", 21)], [("e", 60)]):
            rows = [(film, first + dt.timedelta(days=day)) for film, day in batch]
            spark.createDataFrame(rows, "film_link string, ts timestamp").write.mode("append").parquet(path)
            ops.run_to_table(spark, events, "events", base=base)
    got = values(spark.read.parquet(f"{base}/rows"))
    closed = {r[0]: (r[2] - first.date()).days for r in got if r[1] == "closed"}
    opened = {r[0]: (r[2] - first.date()).days for r in got if r[1] == "opened"}
    assert closed == {"a": 25, "b": 18, "c": 24, "d": 36}
    assert {"a": 0, "b": 3, "c": 9, "d": 21}.items() <= opened.items() and len(got) - len(opened) == len(closed)


def test_stored_sentiment_scores_a_text_once_and_nothing_that_is_known(spark):
    asked = []

    class Models:
        def opinions(self, df, content):
            asked.append(sorted(r[0] for r in df.select(content).collect()))
            label, sure = F.upper(content), F.length(content).cast("double")
            return df.withColumns({"fast_label": label, "fast_confidence": sure, "deep_label": label, "deep_confidence": sure})

    schema = "film_link string, source string, external_id string, review_content string"
    rows = [(f"m/{i}", "a", None if i % 3 == 0 else str(i), ("good", "bad")[i % 2]) for i in range(30)]
    log = classify.sentiment_log(spark, session.fresh_path(spark, "sentiments"))
    for run in (0, 0, 1):
        classify.store_sentiment(log, spark.createDataFrame(rows, schema), Models(), run)
    log.compact()
    classify.store_sentiment(log, spark.createDataFrame(rows, schema), Models(), 1)
    assert asked == [["bad", "good"], ["bad", "good"], []]
    got = sorted((r.film_link, r.fast_label) for r in log.read().collect())
    assert got == sorted((r[0], r[3].upper()) for r in rows)


def test_texts_are_dealt_out_by_their_bytes(spark, monkeypatch):
    """Twice the text gives twice the partitions, so a task's share of words stays the same."""
    monkeypatch.setattr(session, "TEXT_PART", 1 << 16)
    text = "a word and another " * 100
    for rows in (400, 800):
        df = spark.range(rows).select(F.col("id").cast("string").alias("text_id"), F.concat(F.lit(text), "id").alias("text"))
        parts = session.spread(df, "text", "text_id", "texts")
        size = df.agg(F.sum(F.octet_length("text"))).first()[0]
        assert parts.rdd.getNumPartitions() == -(-size // (1 << 16))
        assert parts.count() == rows
        rated = linear.rated_counts(df.withColumn("label", F.lit(1)), "text", "label")
        assert session.cut_lineage(spark, rated).rdd.getNumPartitions() > 8


def test_documents_of_one_row_group_are_analysed_by_several_tasks(spark, folder):
    assert "REPARTITION_BY_COL" in plan(load_all()["document_aspects"](spark, folder))


def test_documents_are_cut_into_sentences_once(spark, folder):
    """Not before they are dealt out, and not once for each aspect."""
    shown = plan(load_all()["document_aspects"](spark, folder)).partition("REPARTITION_BY_COL")
    assert shown[0].count("split(") == 1 and "split(" not in shown[2]


def test_every_review_has_eight_aspects(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (4, "The cast is superb here.")], "k long, body string")
    found = values(aspects.aspect_rows(rows, "body", with_text=False).select("k", "aspect", "confidence"))
    assert sorted((k, a) for k, a, _ in found) == sorted((k, a) for k in range(1, 5) for a in aspects.ASPECTS)
    assert {(k, a) for k, a, c in found if c} == {(4, aspects.ASPECTS[0])}


def test_sessions_go_on_from_batch_to_batch_without_a_state_store(spark, tmp_path):
    first = dt.datetime(2024, 1, 1)
    base, path = session.fresh_path(spark, "sessions"), str(tmp_path / "landing")
    folders.create(spark, path)
    stream = ops.read_parquet_stream(spark, path, "film_link string, ts timestamp")

    def run(rows) -> list[tuple]:
        batch = [(film, None if day is None else first + dt.timedelta(days=day)) for film, day in rows]
        spark.createDataFrame(batch, "film_link string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        query = ops.session_batches(stream, "ts", f"{base}/rows", f"{base}/state")
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
        found = values(ops.closed_sessions(spark, f"{base}/rows"))
        return sorted(((f or ""), (a - first).days, (b - first).days, n) for f, a, b, n in found)

    assert run([("a", 0), ("a", 14), ("b", 1), ("b", 1), (None, 2), ("c", 20), ("c", None)]) == [("", 2, 16, 1), ("b", 1, 15, 2)]
    closed = [("", 2, 16, 1), ("a", 0, 40, 3), ("b", 1, 15, 2), ("c", 20, 34, 1)]
    # of the second batch, b's day 3 is past; a's day 26 reaches the session that is open
    assert run([("a", 26), ("b", 3), ("c", 50), ("c", 60)]) == closed
    assert run([("d", 300)]) == [*closed, ("c", 50, 74, 2)]
    assert run([("", 9_000)]) == [*closed, ("c", 50, 74, 2), ("d", 300, 314, 1)]
