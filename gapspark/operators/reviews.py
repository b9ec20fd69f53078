"""Questions about stored reviews: newest per film, counts, load statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, scores, text
from gapspark.operators import merge


def newest_first() -> list[Column]:
    """Order of the reviews of a film; the review key breaks ties."""
    return [F.desc_nulls_last("review_date"), F.asc("source"), F.asc("external_id")]


def film_reviews(films: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every film with its reviews; films without reviews stay as one row.

    An inner join plus the films that have none: unlike the null-supplying side of
    an outer join, the reviews of a hot film can then be split over tasks.
    """
    own = reviews.withColumnRenamed("source", "review_source")
    matched = films.join(own, "film_link")
    lonely = films.join(own.select("film_link").distinct(), "film_link", "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def latest_reviews(
    reviews: DataFrame, n: int = fixed.LATEST_REVIEWS, salts: int = merge.SALTS
) -> DataFrame:
    """The newest n reviews of every film, placed from 1."""
    return merge.top_per_group(reviews, ["film_link"], newest_first(), n, salts=salts)


def has_label(word: str) -> Column:
    """Whether a review's cached sentiment is positive or negative.

    The second opinion decides when there is one.
    """
    label = F.coalesce(F.nullif("deep_label", F.lit("")), F.col("fast_label"))
    return label.isin(word.upper(), word.capitalize())


def review_stats(reviews: DataFrame, normalise: bool = False) -> DataFrame:
    """Per film: reviews, rotten and fresh counts and percentages, sentiment counts.

    Types must match exactly unless ``normalise`` is set. Sentiment counts are
    zero for a frame without the label columns.
    """
    kind = text.normalised_type(F.col("review_type")) if normalise else F.col("review_type")
    labelled = {"deep_label", "fast_label"} <= set(reviews.columns)
    zero = F.lit(0).cast("bigint")
    counted = reviews.groupBy("film_link").agg(
        F.count("*").alias("total_reviews"),
        F.count_if(kind == "Rotten").alias("rotten_count"),
        F.count_if(kind == "Fresh").alias("fresh_count"),
        (F.count_if(has_label("negative")) if labelled else zero).alias("negative_count"),
        (F.count_if(has_label("positive")) if labelled else zero).alias("positive_count"),
    )
    return counted.select(
        "*",
        scores.percent(F.col("rotten_count"), F.col("total_reviews")).alias("rotten_pct"),
        scores.percent(F.col("fresh_count"), F.col("total_reviews")).alias("fresh_pct"),
    )


def review_load_stats(
    reviews: DataFrame,
    since: str | dt.date = "2020-10-01",
    sources: tuple[str, ...] = ("guardian", "nyt"),
) -> DataFrame:
    """Reviews per source since a day, and the films that got any of them.

    Films are counted from per-film sums rather than by a distinct over rows: the
    rows combine before the shuffle, whatever share one film has.
    """
    recent = F.col("review_date") >= dates.day(since)
    per_film = (
        reviews.where(recent & F.col("source").isin(*sources))
        .groupBy("film_link")
        .agg(*(F.count_if(F.col("source") == s).alias(f"{s}_reviews") for s in sources))
    )
    return per_film.agg(
        *(
            F.coalesce(F.sum(f"{s}_reviews"), F.lit(0).cast("bigint")).alias(f"{s}_reviews")
            for s in sources
        ),
        F.count("*").alias("films_with_reviews"),
    )


def review_sketches(reviews: DataFrame, by: str = "month", lg_k: int = 12) -> DataFrame:
    """Per source and ``by``: number of reviews and a sketch of their films.

    Rows of disjoint inputs add up: store them and append those of new reviews instead
    of counting again. A sketch has at most 2**lg_k bytes, however many films it saw.
    """
    return reviews.groupBy("source", by).agg(
        F.count("*").alias("reviews"), F.hll_sketch_agg("film_link", lg_k).alias("films")
    )


def sketch_error(lg_k: int = 12) -> float:
    """Three standard errors of a merged sketch, as a share of the true number."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def sketched_load_stats(
    sketches: DataFrame, since, sources: tuple[str, ...] = ("guardian", "nyt"), by: str = "month"
) -> DataFrame:
    """The load statistics from stored sketches: counts exact, films estimated.

    ``since`` is the first value of ``by`` that counts. Reads the sketches only. An empty
    table and sources without rows give 0.
    """
    recent = sketches.where((F.col(by) >= since) & F.col("source").isin(*sources))
    counts = (
        F.coalesce(F.sum(F.when(F.col("source") == s, F.col("reviews"))), F.lit(0)).cast("bigint").alias(f"{s}_reviews")
        for s in sources
    )
    films = F.hll_sketch_estimate(F.hll_union_agg("films"))
    return recent.agg(*counts, F.coalesce(films, F.lit(0)).cast("bigint").alias("films_with_reviews"))
