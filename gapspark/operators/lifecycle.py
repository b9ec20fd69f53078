"""The review window of a film: opening, closing, and the daily batch around it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, scores
from gapspark.operators import catalog, link, merge
from gapspark.session import cut_lineage


def closing_reason(asof) -> Column:
    """Why an open film must close; NULL for one that stays open.

    A film with a release date that never had a review closes by age alone; one
    with reviews when they stop; the quiet-fetch rule is left for films without a
    release date.
    """
    released, updated = F.col("release_date"), F.col("reviews_updated_on")
    by_age = dates.days_since(released, asof) > fixed.WINDOW_DAYS
    went_quiet = dates.days_since(updated, asof) > fixed.QUIET_DAYS
    never_found = updated.isNull() & (
        dates.days_since(F.col("last_fetched_on"), asof) > fixed.QUIET_DAYS
    )
    reason = (
        F.when(released.isNotNull() & updated.isNull(), F.when(by_age, fixed.REASON_NO_REVIEWS))
        .when(went_quiet, fixed.REASON_WENT_QUIET)
        .when(never_found, fixed.REASON_NEVER_FOUND)
    )
    return F.when(F.col("review_fetch_active") == 1, reason)


def closing_films(films: DataFrame, asof) -> DataFrame:
    """Open films that must close, with the reason."""
    return films.withColumn("reason", closing_reason(asof)).where("reason IS NOT NULL")


def close_windows(films: DataFrame, asof) -> DataFrame:
    """Films after closing; a projection, as the rules only look at the own row."""
    return films.withColumn(
        "review_fetch_active",
        F.when(closing_reason(asof).isNotNull(), 0).otherwise(F.col("review_fetch_active")),
    )


def reopen(films: DataFrame, linked: DataFrame, asof) -> DataFrame:
    """Closed films an article was linked to, as they look once open again."""
    return (
        films.where(F.coalesce("review_fetch_active", F.lit(0)) == 0)
        .join(linked.select("film_link"), "film_link", "left_semi")
        .withColumn("review_fetch_active", F.lit(1))
        .withColumn("reviews_updated_on", dates.day(asof))
        .withColumn("last_fetched_on", F.lit(None).cast("date"))
    )


def touch_linked(films: DataFrame, linked: DataFrame, added: DataFrame, asof) -> DataFrame:
    """Films after a batch of articles was linked.

    Every linked film is open and was fetched today; only one that got a review
    which was not stored before, or was reopened, counts as updated.
    """
    per_film = linked.select("film_link").distinct().withColumn("_linked", F.lit(True))
    new_per_film = added.select("film_link").distinct().withColumn("_added", F.lit(True))
    was_closed = F.coalesce("review_fetch_active", F.lit(0)) == 0
    updated = F.col("_linked") & (F.col("_added").isNotNull() | was_closed)
    now = dates.day(asof)
    return (
        films.join(per_film, "film_link", "left")
        .join(new_per_film, "film_link", "left")
        .withColumn(
            "reviews_updated_on",
            F.when(updated, now).otherwise(F.col("reviews_updated_on")),
        )
        .withColumn(
            "last_fetched_on", F.when(F.col("_linked"), now).otherwise(F.col("last_fetched_on"))
        )
        .withColumn(
            "review_fetch_active",
            F.when(F.col("_linked"), 1).otherwise(F.col("review_fetch_active")),
        )
        .drop("_linked", "_added")
    )


def score_backlog_run(
    films: DataFrame, answers: DataFrame, asof, limit: int | None = None
) -> DataFrame:
    """Films after asking for the scores of the backlog.

    ``answers`` holds (imdb_id, critic_score, audience_proxy) of the services that
    answered. Every film asked for is stamped, scored or not.
    """
    asked = catalog.score_backlog(films, limit).select("film_link", "imdb_id")
    results = asked.join(answers, "imdb_id", "left").select(
        "film_link", "critic_score", F.col("audience_proxy").alias("audience_score")
    )
    return merge.apply_scores(films, results, dates.day(asof))


def refresh_active_scores(
    films: DataFrame, answers: DataFrame, asof, proxy_audience: bool = True
) -> DataFrame:
    """Open films with an answered critic score take it.

    A known audience score stays; a missing one is filled from the proxy unless
    ``proxy_audience`` is off. A gap that cannot be computed keeps its old value.
    """
    fresh = answers.where("critic_score IS NOT NULL").select(
        "imdb_id",
        F.col("critic_score").alias("_critic"),
        F.col("audience_proxy").alias("_proxy"),
    )
    hit = (F.col("review_fetch_active") == 1) & F.col("_critic").isNotNull()
    fills = F.lit(proxy_audience) & hit & F.col("audience_score").isNull()
    fills = fills & F.col("_proxy").isNotNull()
    # films without an id are nobody's match; kept out of the join they do not meet in one task
    known, unknown = films.where("imdb_id IS NOT NULL"), films.where("imdb_id IS NULL")
    joined = known.join(fresh, "imdb_id", "left").withColumns(
        {
            "audience_score_source": F.when(fills, fixed.PROXY_SOURCE).otherwise(
                F.col("audience_score_source")
            ),
            "audience_score": F.when(fills, F.col("_proxy")).otherwise(F.col("audience_score")),
            "critic_score": F.when(hit, F.col("_critic")).otherwise(F.col("critic_score")),
            "scores_fetched_on": F.when(hit, dates.day(asof)).otherwise(
                F.col("scores_fetched_on")
            ),
            "_hit": hit,
        }
    )
    new_gap = scores.gap(F.col("critic_score"), F.col("audience_score"), 2)
    merged_gap = F.when(F.col("_hit"), F.coalesce(new_gap, F.col("gap"))).otherwise(F.col("gap"))
    label = F.when(F.col("_hit"), scores.gap_label(merged_gap)).otherwise(F.col("gap_label"))
    merged = joined.withColumns({"gap": merged_gap, "gap_label": label}).select(*films.columns)
    return merged.unionByName(unknown)


def score_found(
    found: DataFrame, answers: DataFrame, asof, proxy_audience: bool = True
) -> DataFrame:
    """Discovered films with the scores that were answered for them.

    Only an answered film is stamped; the others are left to the backlog.
    """
    proxy = F.col("audience_proxy") if proxy_audience else F.lit(None).cast("double")
    scored = answers.select("imdb_id", "critic_score", proxy.alias("audience_score"))
    gap = scores.gap(F.col("critic_score"), F.col("audience_score"), 2)
    return (
        found.drop("critic_score", "audience_score")
        .join(scored.withColumn("scores_fetched_on", dates.day(asof)), "imdb_id", "left")
        .withColumn("gap", gap)
        .withColumn("gap_label", scores.gap_label(F.col("gap")))
        .withColumn(
            "audience_score_source",
            F.when(F.col("audience_score").isNotNull(), fixed.PROXY_SOURCE),
        )
    )


def add_found(films: DataFrame, found: DataFrame) -> DataFrame:
    """Films with those found and not yet stored."""
    fresh = merge.new_rows(films, found, ["film_link"], [F.col("tmdb_id")])
    return films.unionByName(fresh, allowMissingColumns=True)


@dataclass(frozen=True)
class DailyResult:
    films: DataFrame
    new_reviews: DataFrame


def daily_update(
    films: DataFrame,
    reviews: DataFrame,
    found: DataFrame | None,
    answers: DataFrame,
    articles: DataFrame,
    asof,
    backlog_limit: int | None = None,
) -> DailyResult:
    """One day's batch: discover, score the backlog, refresh, link articles, close.

    ``answers`` holds one row per imdb_id, ``articles`` the review rows of all
    sources with a film_title. Every step is a set operation over its whole input.
    What several later steps read (the scored films, the linked articles, the new
    reviews) is checkpointed in the shared folder, so that no step repeats those
    before it and a lost executor costs only its own tasks.
    """
    current = films
    if found is not None:
        current = add_found(films, score_found(found, answers, asof))
    current = score_backlog_run(current, answers, asof, backlog_limit)
    spark = films.sparkSession
    current = cut_lineage(spark, refresh_active_scores(current, answers, asof))
    linked = cut_lineage(spark, link.linked_reviews(articles, current))
    added = cut_lineage(spark, link.add_linked(reviews, linked))
    current = touch_linked(current, linked, added, asof)
    return DailyResult(films=close_windows(current, asof), new_reviews=added)
