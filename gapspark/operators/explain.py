"""Why critics and audiences split on a film: counts, quotes and a short text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import scores, text
from gapspark.operators import catalog, merge, reviews as review_ops


def quote_candidates(reviews: DataFrame, salts: int = merge.SALTS) -> DataFrame:
    """The newest reviews per film and type that a quote may come from.

    Twelve per type are enough for every case: the newest ten of a film are each
    among the newest ten of their own type. Only the quote travels, not the text,
    and each map partition is cut to twelve rows per film and type before the
    shuffle.
    """
    kind = F.when(F.col("review_type").isin("Rotten", "Fresh"), F.col("review_type"))
    slim = reviews.select(
        "film_link",
        "review_date",
        "source",
        "external_id",
        "critic_name",
        "publisher_name",
        "review_type",
        F.coalesce(kind, F.lit("other")).alias("kind"),
        text.first_quote(F.col("review_content")).alias("quote"),
    )
    return merge.top_per_group(
        slim, ["film_link", "kind"], review_ops.newest_first(), fixed.QUOTE_LEAD, "kind_place",
        salts,
    )


def quotes(films: DataFrame, reviews: DataFrame, salts: int = merge.SALTS) -> DataFrame:
    """Up to three quotes per film, the side that explains the gap first.

    A film audiences preferred is explained by its rotten reviews, one critics
    preferred by its fresh ones; otherwise the newest reviews speak.
    """
    rated = catalog.scored_films(films).select("film_link", "gap")
    near = quote_candidates(reviews, salts).join(rated, "film_link")
    overall = Window.partitionBy("film_link").orderBy(*review_ops.newest_first())
    gap, kind, kind_place = F.col("gap"), F.col("kind"), F.col("kind_place")
    lead = F.when(gap < -fixed.GAP_BOUND, "Rotten").when(gap > fixed.GAP_BOUND, "Fresh")
    order = (
        F.when(lead.isNull(), F.when(F.col("any_place") <= fixed.QUOTE_ANY, F.col("any_place")))
        .when(kind == lead, kind_place)
        .when(
            (kind != "other") & (kind_place <= fixed.QUOTE_OTHER),
            kind_place + fixed.QUOTE_LEAD,
        )
    )
    ranked = (
        near.withColumn("any_place", F.row_number().over(overall))
        .withColumn("turn", order)
        .where("turn IS NOT NULL AND quote IS NOT NULL")
    )
    place = F.row_number().over(Window.partitionBy("film_link").orderBy("turn"))
    return (
        ranked.withColumn("place", place)
        .where(F.col("place") <= fixed.QUOTES_SHOWN)
        .select(
            "film_link",
            "place",
            F.col("quote").alias("quote_text"),
            F.coalesce("critic_name", F.lit("")).alias("critic"),
            F.coalesce("publisher_name", F.lit("")).alias("publisher"),
            F.coalesce("review_type", F.lit("")).alias("quote_type"),
        )
    )


def explanation(gap: Column, critic: Column, audience: Column, stats: dict[str, Column]) -> Column:
    """The text for one film; zero reviews come before the size of the gap."""
    points = scores.gap_points(gap)
    critic_pct, audience_pct = scores.whole(critic), scores.whole(audience)
    total = stats["total_reviews"]
    return (
        F.when(
            total == 0,
            F.format_string(fixed.EXPLAIN_NO_REVIEWS, critic_pct, audience_pct, points),
        )
        .when(
            gap < -fixed.GAP_BOUND,
            F.format_string(
                fixed.EXPLAIN_AUDIENCE,
                points, total, stats["rotten_count"], stats["rotten_pct"], audience_pct,
            ),
        )
        .when(
            gap > fixed.GAP_BOUND,
            F.format_string(
                fixed.EXPLAIN_CRITICS,
                points, total, stats["fresh_count"], stats["fresh_pct"], audience_pct,
            ),
        )
        .otherwise(F.format_string(fixed.EXPLAIN_AGREE, critic_pct, audience_pct, points))
    )


STAT_COLUMNS = (
    "total_reviews", "rotten_count", "fresh_count", "negative_count", "positive_count",
    "rotten_pct", "fresh_pct",
)


def explain_texts(films: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per film: counts, direction, gap in points and the explanation.

    A film without all three scores keeps its row with has_data false.
    """
    stats = review_ops.review_stats(reviews)
    joined = films.select("film_link", "critic_score", "audience_score", "gap").join(
        stats, "film_link", "left"
    )
    has_data = (
        F.col("critic_score").isNotNull()
        & F.col("audience_score").isNotNull()
        & F.col("gap").isNotNull()
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in STAT_COLUMNS}
    texts = explanation(F.col("gap"), F.col("critic_score"), F.col("audience_score"), zero)
    return joined.select(
        "film_link",
        "gap",
        has_data.alias("has_data"),
        F.when(has_data, texts).alias("explanation"),
        *(F.when(has_data, zero[c]).alias(c) for c in STAT_COLUMNS[:5]),
        F.when(has_data, scores.direction(F.col("gap"))).alias("direction"),
        F.when(has_data, scores.gap_points(F.col("gap"))).alias("gap_points"),
    )


def explain(films: DataFrame, reviews: DataFrame) -> DataFrame:
    """The full explanation row of every film, quotes as an array in order."""
    said = F.sort_array(
        F.collect_list(F.struct("place", "quote_text", "critic", "publisher", "quote_type"))
    )
    per_film = quotes(films, reviews).groupBy("film_link").agg(said.alias("quotes"))
    return explain_texts(films, reviews).join(per_film, "film_link", "left")


def worth_showing(explained: DataFrame, bound: int = fixed.EXPLAIN_BOUND) -> DataFrame:
    """Explanations that have data and a gap of some size."""
    return explained.where(F.col("has_data") & (F.col("gap_points") >= bound))
