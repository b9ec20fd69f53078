"""Linking articles to films by the title in their headline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.functions import text
from gapspark.operators import merge

REVIEW_KEY = ["film_link", "source", "external_id"]


def title_key(title: Column, fold_accents: bool = False) -> Column:
    """What two equal titles share: their lower case, with or without accents."""
    lowered = F.lower(title)
    return F.collate(lowered, "UNICODE_CI_AI") if fold_accents else lowered


def title_index(films: DataFrame, fold_accents: bool = False) -> DataFrame:
    """(title_key, film_link): the lowest film key of every title."""
    return (
        films.where("movie_title IS NOT NULL")
        .groupBy(title_key(F.col("movie_title"), fold_accents).alias("title_key"))
        .agg(F.min("film_link").alias("film_link"))
    )


def resolve_titles(
    titles: DataFrame, column: str, films: DataFrame, fold_accents: bool = False
) -> DataFrame:
    """(title_key, film_link) for the distinct titles that have a film.

    The full title decides; failing that the part before its first colon. Working
    on distinct titles keeps a title shared by very many articles to one row and
    the article bodies out of these joins.
    """
    wanted = (
        titles.where(F.col(column) != "")
        .select(
            title_key(F.col(column), fold_accents).alias("title_key"),
            title_key(text.main_title(F.col(column)), fold_accents).alias("short_key"),
        )
        .distinct()
    )
    index = title_index(films, fold_accents)
    by_short = index.select(
        F.col("title_key").alias("short_key"), F.col("film_link").alias("short_link")
    )
    return (
        wanted.join(index, "title_key", "left")
        .join(by_short, "short_key", "left")
        .groupBy("title_key")
        .agg(F.min(F.coalesce("film_link", "short_link")).alias("film_link"))
        .where("film_link IS NOT NULL")
    )


def link_articles(
    articles: DataFrame, films: DataFrame, title: str = "film_title", fold_accents: bool = False
) -> DataFrame:
    """Articles with the film_link of their title, NULL when there is none."""
    found = resolve_titles(articles.select(title), title, films, fold_accents)
    return (
        articles.withColumn("title_key", title_key(F.col(title), fold_accents))
        .join(found, "title_key", "left")
        .drop("title_key")
    )


def linked_reviews(articles: DataFrame, films: DataFrame, title: str = "film_title") -> DataFrame:
    """Articles that belong to a film, as review rows."""
    return link_articles(articles, films, title).where("film_link IS NOT NULL").drop(title)


def link_rate(linked: DataFrame, stored: DataFrame) -> DataFrame:
    """Per source and month: articles fetched, linked, and not stored before.

    ``linked`` has source, external_id, review_date, has_body and film_link.
    """
    known = stored.select(*REVIEW_KEY).join(
        linked.select(*REVIEW_KEY), REVIEW_KEY, "left_semi"
    ).distinct()
    flagged = linked.join(
        known.withColumn("_known", F.lit(True)), REVIEW_KEY, "left"
    )
    matched = F.col("has_body") & F.col("film_link").isNotNull()
    return flagged.groupBy("source", F.date_format("review_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("fetched"),
        F.count_if(matched).alias("matched"),
        F.count_distinct(
            F.when(matched & F.col("_known").isNull(), F.struct("film_link", "external_id"))
        ).alias("inserted"),
    )


def add_linked(stored: DataFrame, linked: DataFrame) -> DataFrame:
    """Review rows of a batch that are really new."""
    return merge.new_rows(stored, linked, REVIEW_KEY, [F.col("review_date"), F.col("critic_name")])
