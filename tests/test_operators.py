"""Edge rows and invariants of the operators."""

import datetime as dt
import json

import pytest
from frames import values
from pyspark.sql import functions as F

from gapspark import fixed, schemas
from gapspark.operators import catalog, explain, lifecycle, link, merge, reviews, trend
from gapspark.plans.fixtures import Views
from gapspark.sources import csv_files, documents, months, tables


# --- catalogue ---------------------------------------------------------------


def films(spark, rows):
    return spark.createDataFrame(
        rows, "film_link string, movie_title string, critic_score double, audience_score double"
    )


def test_leaderboard_breaks_ties_by_key(spark):
    df = catalog.with_gap(films(spark, [(f"m/{i}", f"T{i}", 50.0, 50.0) for i in range(9)]))
    board = catalog.leaderboard(df, 4).orderBy("side", "place")
    assert [(r.side, r.place, r.film_link) for r in board.collect()] == [
        ("audience_favoured", 1, "m/0"), ("audience_favoured", 2, "m/1"),
        ("critic_favoured", 1, "m/0"), ("critic_favoured", 2, "m/1"),
    ]


def test_overview_of_films_without_gap(spark):
    df = catalog.with_gap(films(spark, [("m/1", "A", None, 10.0), ("m/2", "B", 5.0, None)]))
    assert values(catalog.overview(df)) == [(2, None, None, None)]


def test_overview_names_a_film_without_title_as_null(spark):
    df = catalog.with_gap(films(spark, [("m/1", None, 90.0, 10.0), ("m/2", "B", 5.0, 50.0)]))
    assert values(catalog.overview(df)) == [(2, 17.5, None, "B")]


def test_browse_clips_page_arguments(spark, folder):
    page = catalog.browse(Views(spark, folder).gap_films, page=0, per_page=500)
    row = page.first()
    assert (row.page, row.per_page, row.total, row.total_pages) == (1, 100, 200, 2)
    assert page.count() == 100


def test_browse_of_nothing(spark, folder):
    assert catalog.browse(Views(spark, folder).gap_films, from_year=2050).count() == 0


def test_unknown_sort_keeps_key_order(spark, folder):
    page = catalog.browse(Views(spark, folder).gap_films, sort_by="?", per_page=3)
    assert [r.film_link for r in page.collect()] == ["m/0", "m/1", "m/10"]


@pytest.mark.parametrize("sort_by", ["divergence", "critics", "audience", "newest", "oldest", "?"])
def test_keyset_pages_equal_offset_pages(spark, folder, sort_by):
    df = Views(spark, folder).gap_films.select(*catalog.CARD_COLUMNS).cache()
    value = {
        "divergence": lambda r: None if r.gap is None else abs(r.gap),
        "critics": lambda r: r.critic_score,
        "audience": lambda r: r.audience_score,
        "newest": lambda r: r.release_year,
        "oldest": lambda r: r.release_year,
        "?": lambda r: None,
    }[sort_by]
    everything = df.orderBy(*catalog.browse_order(sort_by)).collect()
    for at in (0, 57, 150, 190):
        last = everything[at]
        page = catalog.browse_after(df, sort_by, value(last), last.film_link, 9).collect()
        assert [r.film_link for r in page] == [
            r.film_link for r in everything[at + 1: at + 10]
        ]


def test_search_literal_and_pattern(spark):
    df = films(spark, [("m/1", "Se7en (1995)", 1.0, 1.0), ("m/2", None, 1.0, 1.0)])
    assert catalog.search(df, "se.en").count() == 1
    assert catalog.search(df, "(1995)", literal=True).count() == 1
    assert catalog.search(df, "se.en", literal=True).count() == 0
    assert catalog.search(df, "").count() == 0


def test_film_lookup(spark):
    df = films(spark, [("m/1", "A", 1.0, 1.0), ("m/2", "B", 1.0, 1.0)])
    assert catalog.film(df, "m/2").first().movie_title == "B"


def test_genre_counts(spark):
    df = spark.createDataFrame(
        [("A, B,A", 10.0), ("A", 40.0), (None, 5.0), ("B", None)], "genres string, gap double"
    )
    got = values(catalog.genre_breakdown(df, min_films=1))
    assert got == [("A", 20.0, 3), ("B", 10.0, 1)]


# --- merge -------------------------------------------------------------------

KEY = ["film_link", "source", "external_id"]


def test_insert_ignore_null_keys_never_collide(spark):
    rows = [("m/1", "a", "1", "x"), ("m/1", "a", "1", "y"), ("m/1", "a", None, "z"),
            ("m/1", "a", None, "z")]
    incoming = spark.createDataFrame(
        rows, "film_link string, source string, external_id string, body string"
    )
    stored = incoming.limit(0)
    once = merge.insert_ignore(stored, incoming, KEY, [F.col("body")])
    assert sorted(values(once), key=str) == sorted(
        [("m/1", "a", "1", "x"), ("m/1", "a", None, "z"), ("m/1", "a", None, "z")], key=str
    )
    keyed = incoming.where("external_id IS NOT NULL")
    again = merge.insert_ignore(once, keyed, KEY, [F.col("body")])
    assert again.count() == once.count()


def test_upsert_never_wipes_a_score(spark):
    columns = "film_link string, movie_title string, critic_score double, gap double, gap_label string"
    stored = spark.createDataFrame([("m/1", "Old", 80.0, 30.0, "x"), ("m/2", None, None, None, "y")], columns)
    incoming = spark.createDataFrame(
        [("m/1", "New", None, None, "z"), ("m/2", "Two", 10.0, -40.0, None), ("m/3", "Three", 5.0, 1.0, None)],
        columns,
    )
    merged = merge.upsert_films(stored, incoming)
    want = [
        ("m/1", "Old", 80.0, 30.0, fixed.LABEL_CRITICS),
        ("m/2", None, 10.0, -40.0, fixed.LABEL_AUDIENCE),
        ("m/3", "Three", 5.0, 1.0, fixed.LABEL_ALIGNED),
    ]
    assert values(merged.orderBy("film_link")) == want
    assert values(merge.upsert_films(merged, incoming).orderBy("film_link")) == want


def test_collapse_updates_like_writes_in_a_row(spark):
    df = spark.createDataFrame(
        [("m/1", 1, "first", 5.0), ("m/1", 2, "second", None), ("m/1", 3, "third", 7.0),
         ("m/1", 4, "fourth", None)],
        "film_link string, at int, movie_title string, critic_score double",
    )
    got = merge.collapse_updates(df, "film_link", F.col("at"), ["critic_score"]).first()
    assert (got.movie_title, got.critic_score) == ("first", 7.0)


def test_merge_updates(spark):
    base = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "film_link string, x int, y int")
    new = spark.createDataFrame([("a", None, None), ("c", 9, 9)], "film_link string, x int, y int")
    got = merge.merge_updates(base, new, "film_link", overwrite=["x"], fill=["y"])
    assert values(got.orderBy("film_link")) == [("a", None, 2), ("b", 3, 4)]


def test_apply_scores_stamps_an_answer_without_scores(spark):
    day = F.lit("2024-06-01").cast("date")
    base = spark.createDataFrame(
        [("a", None, 50.0, None, None, "old", None), ("b", None, None, None, None, "old", None),
         ("c", 1.0, 1.0, None, 0.0, "old", None)],
        "film_link string, critic_score double, audience_score double, audience_score_source string,"
        " gap double, gap_label string, scores_fetched_on date",
    )
    scored = spark.createDataFrame(
        [("a", None, None), ("b", 90.0, 60.5)],
        "film_link string, critic_score double, audience_score double",
    )
    got = values(merge.apply_scores(base, scored, day).orderBy("film_link"))
    stamp = dt.date(2024, 6, 1)
    assert got == [
        ("a", None, 50.0, None, None, "old", stamp),
        ("b", 90.0, 60.5, "imdb", 29.5, fixed.LABEL_CRITICS, stamp),
        ("c", 1.0, 1.0, None, 0.0, "old", None),
    ]


# --- linking -----------------------------------------------------------------


def test_colon_title_falls_back(spark):
    known = spark.createDataFrame(
        [("m/9", "dune"), ("m/5", "Dune"), ("m/1", None), ("m/2", "Heat: Part One")],
        "film_link string, movie_title string",
    )
    articles = spark.createDataFrame(
        [("1", "Dune: Part Two"), ("2", "DUNE"), ("3", "heat: part one"), ("4", "Heat"), ("5", "")],
        "external_id string, film_title string",
    )
    linked = link.link_articles(articles, known).orderBy("external_id")
    assert [(r.external_id, r.film_link) for r in linked.collect()] == [
        ("1", "m/5"), ("2", "m/5"), ("3", "m/2"), ("4", None), ("5", None),
    ]


def test_titles_may_differ_in_accents(spark):
    known = spark.createDataFrame(
        [("m/2", "Amélie"), ("m/3", "Amelie")], "film_link string, movie_title string"
    )
    articles = spark.createDataFrame(
        [("1", "AMELIE"), ("2", "Amélie"), ("3", "amelié: the return")],
        "external_id string, film_title string",
    )
    plain = link.link_articles(articles, known).orderBy("external_id")
    assert [r.film_link for r in plain.collect()] == ["m/3", "m/2", None]
    folded = link.link_articles(articles, known, fold_accents=True).orderBy("external_id")
    assert [r.film_link for r in folded.collect()] == ["m/2", "m/2", "m/2"]


# --- reviews and explanation -------------------------------------------------


def test_review_stats_without_labels(spark):
    df = spark.createDataFrame(
        [("m/1", "Rotten"), ("m/1", "rotten"), ("m/1", None)], "film_link string, review_type string"
    )
    row = reviews.review_stats(df).first()
    assert (row.total_reviews, row.rotten_count, row.fresh_count, row.rotten_pct) == (3, 1, 0, 33)
    assert (row.negative_count, row.positive_count) == (0, 0)


def quotable(i):
    return f"This is sentence number {i} of many reviews."


def review_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "film_link string, review_date date, source string, external_id string, critic_name string,"
        " publisher_name string, review_type string, review_content string",
    )


def test_quotes_lead_with_the_explaining_side(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        ("m/1", day + dt.timedelta(days=i), "s", f"{i:02d}", "c", None,
         "Rotten" if i < 2 else "Fresh", quotable(i))
        for i in range(20)
    ]
    made = review_frame(spark, rows)
    base = films(spark, [("m/1", "A", 10.0, 90.0)])
    got = explain.quotes(catalog.with_gap(base), made).orderBy("place").collect()
    assert [r.quote_text for r in got] == [quotable(1), quotable(0), quotable(19)]
    assert got[0].publisher == ""
    base = films(spark, [("m/1", "A", 50.0, 50.0)])
    got = explain.quotes(catalog.with_gap(base), made).orderBy("place").collect()
    assert [r.quote_text for r in got] == [quotable(19), quotable(18), quotable(17)]


def test_quotes_look_no_further_than_the_candidates(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        ("m/1", day - dt.timedelta(days=i), "s", f"{i:02d}", "c", "p", "Fresh",
         "Short." if i < 12 else quotable(i))
        for i in range(14)
    ]
    base = catalog.with_gap(films(spark, [("m/1", "A", 90.0, 10.0)]))
    assert explain.quotes(base, review_frame(spark, rows)).count() == 0


def test_a_hot_film_gives_the_same_with_and_without_salts(spark, folder):
    """One film with a third of all reviews, from many map tasks."""
    made = Views(spark, folder).reviews.withColumn(
        "film_link",
        F.when(F.xxhash64("external_id") % 3 == 0, "m/hot").otherwise(F.col("film_link")),
    ).repartition(12)
    assert made.where("film_link = 'm/hot'").count() > made.count() / 5
    columns = ["film_link", "place", "source", "external_id", "review_date"]
    plain = reviews.latest_reviews(made.select(*columns[:1], *columns[2:]))
    salted = reviews.latest_reviews(made.select(*columns[:1], *columns[2:]), salts=4)
    key = ["film_link", "place", "review_date"]
    assert sorted(values(plain.select(*key))) == sorted(values(salted.select(*key)))
    base = catalog.with_gap(
        films(spark, [("m/hot", "Hot", 90.0, 10.0), ("m/1", "A", 10.0, 90.0), ("m/2", "B", 5.0, 5.0)])
    )
    shown = ["film_link", "place", "quote_type"]
    left = explain.quotes(base, made).select(*shown)
    right = explain.quotes(base, made, salts=4).select(*shown)
    assert left.where("film_link = 'm/hot'").count() == 3
    assert sorted(values(left)) == sorted(values(right))


def test_explain_row(spark):
    base = catalog.with_gap(films(spark, [("m/1", "A", 90.0, 10.0), ("m/2", "B", None, 1.0)]))
    rows = [("m/1", dt.date(2024, 1, 1), "s", "1", "c", "p", "Fresh", quotable(1))]
    got = {r.film_link: r for r in explain.explain(base, review_frame(spark, rows)).collect()}
    assert got["m/1"].explanation.startswith(
        "Critics rated this film 80 points higher than audiences. Of the 1 critic reviews stored, "
        "1 (100%) are Fresh."
    )
    assert [q.quote_text for q in got["m/1"].quotes] == [quotable(1)]
    assert got["m/2"].has_data is False and got["m/2"].explanation is None


# --- trend -------------------------------------------------------------------


def trend_of(spark, rows):
    made = spark.createDataFrame(rows, "film_link string, review_date date, review_type string")
    known = spark.createDataFrame([("m/1",)], "film_link string")
    return trend.film_trends(known, made).first()


def month(i):
    return dt.date(2020 + i // 12, i % 12 + 1, 5)


def test_trend_guards(spark):
    none = trend_of(spark, [("m/2", month(0), "Fresh")])
    assert (none.warning, none.review_count) == (fixed.WARN_NO_REVIEWS, None)
    few = trend_of(spark, [("m/1", month(0), "Fresh")] * 2)
    assert (few.warning, few.review_count) == (fixed.WARN_FEW_REVIEWS, 2)
    undated = trend_of(spark, [("m/1", None, "Fresh")] * 2 + [("m/1", month(0), "Fresh")])
    assert (undated.warning, undated.review_count) == (fixed.WARN_BAD_DATES, 1)
    short = trend_of(spark, [("m/1", month(i % 2), "Fresh") for i in range(6)])
    assert (short.warning, short.trend, short.p_value) == (None, "no trend", None)


def test_flat_trend(spark):
    got = trend_of(spark, [("m/1", month(i), "Fresh") for i in range(5)])
    assert (got.trend, got.p_value, got.tau) == ("no trend", 1.0, 0.0)


def test_undecided_months_stay_without_ratio(spark):
    made = spark.createDataFrame(
        [("m/1", month(0), "n/a"), ("m/1", month(1), " FRESH"), ("m/1", month(1), "rotten")],
        "film_link string, review_date date, review_type string",
    )
    got = trend.monthly_counts(made).orderBy("month").collect()
    assert [(r.total, r.fresh_ratio) for r in got] == [(0, None), (2, 0.5)]


def test_rolling_mean_skips_nulls(spark):
    rows = [("m/1", month(i), x) for i, x in enumerate([None, 0.5, 1.0, None, 0.0])]
    monthly = spark.createDataFrame(rows, "film_link string, month date, fresh_ratio double")
    got = trend.monthly_rolling(monthly).orderBy("month").collect()
    assert [r.fresh_ratio_rolling for r in got] == [None, 0.5, 0.75, 0.75, 0.5]


def test_stale_refresh_equals_full_run(spark, folder):
    v = Views(spark, folder)
    now = F.lit("2001-11-10").cast("date")
    full = trend.film_trends(v.films, v.plain_reviews).withColumn("analysed_on", now)
    half = full.where("film_link < 'm/150'").withColumn(
        "analysed_on",
        F.when(F.col("film_link") < "m/130", now).otherwise(F.lit("1990-01-01").cast("date")),
    )
    refreshed = trend.refresh_trends(v.films, v.plain_reviews, half, now)
    columns = ["film_link", "trend", "p_value", "tau"]
    assert sorted(values(refreshed.select(*columns)), key=str) == sorted(
        values(full.select(*columns)), key=str
    )


def test_partitioning_does_not_change_results(spark, folder):
    v = Views(spark, folder)
    other = v.plain_reviews.repartition(7, "review_date")
    left = trend.mann_kendall(trend.film_series(v.plain_reviews)).select("film_link", "s", "z")
    right = trend.mann_kendall(trend.film_series(other)).select("film_link", "s", "z")
    assert sorted(values(left)) == sorted(values(right))


# --- lifecycle ---------------------------------------------------------------

TODAY = dt.date(2024, 6, 1)


def ago(days):
    return None if days is None else TODAY - dt.timedelta(days=days)


@pytest.mark.parametrize(
    "released, updated, fetched, reason",
    [
        (90, None, None, None),
        (91, None, None, fixed.REASON_NO_REVIEWS),
        (400, 14, None, None),
        (400, 15, None, fixed.REASON_WENT_QUIET),
        (10, None, 15, None),
        (None, None, 14, None),
        (None, None, 15, fixed.REASON_NEVER_FOUND),
        (None, 15, 1, fixed.REASON_WENT_QUIET),
        (None, None, None, None),
    ],
)
def test_closing_rules(spark, released, updated, fetched, reason):
    df = spark.createDataFrame(
        [("m/1", ago(released), ago(updated), ago(fetched), 1)],
        "film_link string, release_date date, reviews_updated_on date, last_fetched_on date,"
        " review_fetch_active int",
    )
    closing = lifecycle.closing_films(df, TODAY).collect()
    assert [r.reason for r in closing] == ([reason] if reason else [])
    assert lifecycle.close_windows(df, TODAY).first().review_fetch_active == (0 if reason else 1)
    shut = df.withColumn("review_fetch_active", F.lit(0))
    assert lifecycle.closing_films(shut, TODAY).count() == 0


def test_daily_update_twice_adds_nothing(spark, folder):
    from gapspark.plans import lifecycle_queries
    from gapspark.plans.ingest_queries import review_rows
    from gapspark.plans.merge_queries import answers

    v = Views(spark, folder)
    articles = review_rows(v).where("has_body").drop("has_body")
    known = lifecycle_queries.tracked(v)
    empty = articles.limit(0).withColumn("film_link", F.lit("")).drop("film_title")
    first = lifecycle.daily_update(known, empty, None, answers(v), articles, "2001-11-10")
    again = lifecycle.daily_update(
        first.films, first.new_reviews, None, answers(v), articles, "2001-11-11"
    )
    assert first.new_reviews.count() > 0
    assert again.new_reviews.count() == 0


# --- sources -----------------------------------------------------------------


def test_film_list_from_csv(spark, tmp_path):
    path = tmp_path / "films.csv"
    path.write_text(
        "rotten_tomatoes_link,movie_title,critics_consensus,genres,directors,"
        "original_release_date,runtime,tomatometer_rating,audience_rating\n"
        'm/1,"A ""quoted"" title","Two\nlines, one cell","Drama, War",Ann,2024-03-03,101.0,90,60\n'
        ",No key,,,,,,,\n"
        "m/2, ,,,,not a date,long,n/a,50\n",
        encoding="utf-8",
    )
    got = {r.film_link: r for r in csv_files.load_films(spark, str(path), TODAY, multiline=True).collect()}
    assert set(got) == {"m/1", "m/2"}
    one = got["m/1"]
    assert (one.movie_title, one.critics_consensus) == ('A "quoted" title', "Two\nlines, one cell")
    assert (one.runtime, one.gap, one.gap_label) == (101.0, 30.0, fixed.LABEL_CRITICS)
    assert (one.release_year, one.review_fetch_active) == (2024, 1)
    two = got["m/2"]
    assert (two.movie_title, two.critic_score, two.runtime, two.gap) == (None, None, None, None)
    assert (two.gap_label, two.review_fetch_active) == (fixed.LABEL_ALIGNED, 0)


def test_review_list_from_csv(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "rotten_tomatoes_link,critic_name,publisher_name,review_date,review_type,review_score,"
        "review_content\n"
        "m/1,Ann,Post,2020-01-02,Fresh,3/4,Good.\n"
        "m/1,,,,,,\n"
        " ,Bob,Post,2020-01-02,Fresh,,Lost.\n",
        encoding="utf-8",
    )
    got = csv_files.load_reviews(spark, str(path), multiline=True).collect()
    assert len(got) == 2
    empty = next(r for r in got if r.critic_name is None)
    assert (empty.review_content, empty.review_date, len(empty.external_id)) == (None, None, 20)


def test_labelled_corpus_from_csv(spark, tmp_path):
    path = tmp_path / "corpus.csv"
    path.write_text('review,sentiment\n"Fine, really", Positive \nBad,negative\nOdd,\n')
    got = sorted(values(csv_files.load_corpus(spark, str(path), multiline=True).select("text", "label")))
    assert got == [("Bad", 0.0), ("Fine, really", 1.0), ("Odd", 0.0)]


def test_documents_from_json(spark, tmp_path):
    (tmp_path / "scores").mkdir()
    payloads = [
        {"Response": "True", "Ratings": [{"Source": "Rotten Tomatoes", "Value": "87%"}], "imdbRating": "7.5"},
        {"Response": "True", "Ratings": [], "imdbRating": "N/A"},
        {"Response": "True"},
        {"Response": "False"},
    ]
    rows = [(f"tt{i}", json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "imdb_id string, payload string")
    assert sorted(values(documents.parse_scores(df)), key=str) == [
        ("tt0", 87.0, 75.0), ("tt1", None, None), ("tt2", None, None),
    ]
    path = tmp_path / "articles.json"
    path.write_text(
        json.dumps({"id": "film/1", "webPublicationDate": "2024-01-02T03:04:05Z",
                    "fields": {"headline": "Dune review – big", "bodyText": " x " * 4000,
                               "starRating": 2}}) + "\n"
        + json.dumps({"id": "film/2", "fields": {"bodyText": "  "}}) + "\n"
    )
    docs = documents.read_json(spark, str(path), schemas.ARTICLE_DOC_A)
    whole = documents.articles_with_stars(docs).first()
    assert len(whole.review_content) > 6000
    got = documents.articles_with_stars(docs, max_chars=6000).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.film_title, row.critic_name, row.review_type) == ("Dune", "The Guardian", "Rotten")
    assert (row.review_score, len(row.review_content)) == ("2", 6000)
    assert row.review_date == dt.date(2024, 1, 2)


def test_directors_limit(spark):
    crew = F.array(
        *(F.struct(F.lit(n).alias("name"), F.lit("Director").alias("job")) for n in ("A", "B", "C"))
    )
    df = spark.range(1).select(documents.directors(crew), documents.directors(crew, 2))
    assert values(df) == [("A, B, C", "A, B")]


def test_month_partitions_end_at_the_last_day(spark):
    df = spark.createDataFrame([(dt.date(2020, 11, 15),)], "first_day date")
    got = months.month_partitions(df, F.col("first_day"), F.lit("2021-01-10").cast("date"))
    assert values(got.select("month_start", "month_end")) == [
        (dt.date(2020, 11, 1), dt.date(2020, 11, 30)),
        (dt.date(2020, 12, 1), dt.date(2020, 12, 31)),
        (dt.date(2021, 1, 1), dt.date(2021, 1, 10)),
    ]


def test_metrics_file(spark, tmp_path):
    path = str(tmp_path / "metrics")
    made = spark.createDataFrame([("tfidf_logistic", "test", 10, 0.9)], "model string, split string, samples long, accuracy double")
    tables.write_metrics(made, path)
    assert spark.read.json(path).first().accuracy == 0.9


def test_review_table_round_trip(spark, folder, tmp_path):
    path = str(tmp_path / "reviews")
    made = Views(spark, folder).reviews
    tables.append_reviews(made, path)
    back = tables.read_reviews(spark, path)
    assert back.count() == made.count()
    pruned = back.where("review_month = '1999-03'")
    assert pruned.count() == made.where("date_format(review_date, 'yyyy-MM') = '1999-03'").count()
    assert not tables.is_empty(back)
    assert tables.is_empty(back.where("film_link = 'none'"))
