"""The physical plans the operators count on."""

from pyspark.sql import functions as F

from gapspark.operators import aspects, catalog, classify, explain, link, merge, reviews, trend
from gapspark.plans.fixtures import PHRASES, Views
from gapspark.plans.ingest_queries import review_rows
from gapspark.plans.registry import load_all


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_top_lists_need_no_full_sort(spark, folder, capsys):
    shown = plan(catalog.leaderboard(Views(spark, folder).gap_films), capsys)
    assert shown.count("TakeOrderedAndProject") == 2
    page = plan(catalog.browse(Views(spark, folder).gap_films, page=4), capsys)
    assert "TakeOrderedAndProject(limit=80, offset=60" in page


def test_groups_are_cut_before_the_shuffle(spark, folder, capsys):
    v = Views(spark, folder)
    for df in (
        reviews.latest_reviews(v.plain_reviews),
        explain.quote_candidates(v.reviews),
    ):
        shown = plan(df, capsys)
        cut, exchange = shown.index("Partial"), shown.index("Exchange hashpartitioning(film_link"
            if "hashpartitioning(film_link" in shown else "Exchange hashpartitioning(source")
        assert "WindowGroupLimit" in shown
        assert shown.index("Final") < exchange < cut


def test_the_first_row_of_a_key_takes_one_shuffle(spark, folder, capsys):
    firsts = merge.first_per_key(Views(spark, folder).plain_reviews, ["source", "external_id"], [F.col("film_link")])
    shown = plan(firsts, capsys)
    assert shown.count("Exchange") == 1 and "partial_min" in shown and "Window" not in shown


def test_order_columns_given_by_name_travel_once(spark, folder, capsys):
    rows = Views(spark, folder).plain_reviews.select("source", "external_id", "film_link", "review_date", "label")
    keys = ["source", "external_id"]
    named = merge.first_per_key(rows, keys, ["film_link", "source", "review_date"])
    by_column = merge.first_per_key(rows, keys, [F.col("film_link"), F.col("review_date")])
    assert named.columns == rows.columns
    assert named.exceptAll(by_column).count() == by_column.exceptAll(named).count() == 0
    partial = next(line for line in plan(named, capsys).splitlines() if "partial_min" in line)
    assert partial.partition("partial_min")[2].partition("]")[0].count("film_link#") == 1


def test_deduplicated_reviews_send_no_texts(spark, folder, capsys):
    shown = plan(load_all()["review_dedupe"](spark, folder), capsys)
    assert PHRASES[0] not in shown


def test_top_groups_take_one_shuffle_unless_salted(spark, folder, capsys):
    v = Views(spark, folder)
    assert plan(reviews.latest_reviews(v.plain_reviews), capsys).count("Exchange") == 1
    assert plan(reviews.latest_reviews(v.plain_reviews, salts=4), capsys).count("Exchange") == 2


def test_trend_shuffles_month_rows_only(spark, folder, capsys):
    shown = plan(trend.mann_kendall(trend.film_series(Views(spark, folder).plain_reviews)), capsys)
    assert "partial_count" in shown
    assert "Python" not in shown


def test_only_the_needed_columns_are_read(spark, folder, capsys):
    shown = plan(trend.monthly_counts(Views(spark, folder).plain_reviews), capsys)
    assert "ReadSchema: struct<l_partkey:bigint,l_linenumber:int,l_returnflag:string,l_shipdate" in (
        shown.replace("l_orderkey:bigint,", "")
    )


def test_a_split_shuffles_no_text(spark, folder, capsys):
    docs = Views(spark, folder).table("documents").selectExpr("doc_id", "text", "n_chars % 2 AS label")
    shown = plan(classify.stratified_split(docs, "doc_id", "label"), capsys)
    assert "Exchange" not in shown and "Join" not in shown


def test_aspects_need_no_shuffle(spark, folder, capsys):
    raw = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    shown = plan(aspects.aspect_rows(raw, "text"), capsys)
    assert "Exchange" not in shown and "Python" not in shown and "Join" not in shown


def test_linking_leaves_the_bodies_out_of_the_title_joins(spark, folder, capsys):
    v = Views(spark, folder)
    shown = plan(link.resolve_titles(review_rows(v), "film_title", v.gap_films), capsys)
    assert "Body of article" not in shown
    assert "Cartesian" not in shown and "NestedLoop" not in shown


def test_no_query_pairs_everything_with_everything(spark, folder, capsys):
    for name, query in load_all().items():
        if name.startswith(("stream_", "daily_", "classifier", "incremental", "sentiment_", "aspect_stars", "resumed", "review_sent", "review_anal")):
            continue  # these run jobs when built
        shown = plan(query(spark, folder), capsys)
        assert "CartesianProduct" not in shown, name
        assert "BroadcastNestedLoopJoin" not in shown, name
