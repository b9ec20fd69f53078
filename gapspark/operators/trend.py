"""How the critics' verdict on a film moves from month to month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, stats, text
from gapspark.session import written


def _by_month(reviews: DataFrame) -> DataFrame:
    """Counts per film and month; reviews without a date form the NULL month."""
    kind = F.col("review_type")
    counted = reviews.groupBy(
        "film_link", dates.month_of(F.col("review_date")).alias("month")
    ).agg(
        F.count("*").alias("reviews"),
        F.count_if(text.is_type(kind, "Fresh")).alias("fresh_count"),
        F.count_if(text.is_type(kind, "Rotten")).alias("rotten_count"),
    )
    decided = F.col("fresh_count") + F.col("rotten_count")
    return counted.withColumn("total", decided).withColumn(
        "fresh_ratio", F.try_divide(F.col("fresh_count").cast("double"), F.col("total"))
    )


def monthly_counts(reviews: DataFrame) -> DataFrame:
    """Fresh and rotten counts and their ratio per film and month with reviews."""
    return _by_month(reviews).where("month IS NOT NULL").drop("reviews")


def monthly_rolling(monthly: DataFrame, months: int = fixed.ROLLING_MONTHS) -> DataFrame:
    """Mean ratio of the last months that are present; NULL ratios are skipped.

    The window runs over months, not reviews, so its groups are short.
    """
    recent = Window.partitionBy("film_link").orderBy("month").rowsBetween(1 - months, 0)
    return monthly.withColumn("fresh_ratio_rolling", F.avg("fresh_ratio").over(recent))


def chart_points(monthly: DataFrame) -> DataFrame:
    """Months that can be drawn: those with a ratio, for films with at least two."""
    points = F.count("*").over(Window.partitionBy("film_link"))
    return (
        monthly.where("fresh_ratio IS NOT NULL")
        .withColumn("points", points)
        .where("points >= 2")
    )


def film_series(reviews: DataFrame) -> DataFrame:
    """Per film: review counts and the ordered ratios of its months.

    Rows are combined to months before anything is collected, so an array holds
    at most one entry per calendar month.
    """
    ordered = F.sort_array(
        F.collect_list(
            F.when(
                F.col("month").isNotNull() & F.col("fresh_ratio").isNotNull(),
                F.struct("month", "fresh_ratio"),
            )
        )
    )
    dated = F.when(F.col("month").isNotNull(), F.col("reviews"))
    return _by_month(reviews).groupBy("film_link").agg(
        F.sum("reviews").alias("review_count"),
        F.coalesce(F.sum(dated), F.lit(0)).alias("dated_count"),
        F.transform(ordered, lambda m: m["fresh_ratio"]).alias("ratios"),
    )


def mann_kendall(series: DataFrame) -> DataFrame:
    """The trend test for every film with three or more ratios."""
    xs = F.col("ratios")
    return (
        series.where(F.size(xs) >= fixed.TREND_MIN)
        .withColumn("n", F.size(xs))
        .withColumn("s", stats.mk_score(xs))
        .withColumn("var_s", stats.mk_variance(xs))
        .withColumn("z", stats.mk_z(F.col("s"), F.col("var_s")))
        .select(
            "film_link",
            "n",
            "s",
            "var_s",
            "z",
            stats.mk_tau(F.col("s"), F.col("n")).alias("tau"),
            stats.two_sided_p(F.col("z")).alias("p_value"),
            stats.mk_trend(F.col("z")).alias("trend"),
        )
    )


def film_trends(films: DataFrame, reviews: DataFrame) -> DataFrame:
    """The trend of every film, or the reason why it has none."""
    xs = F.col("ratios")
    total, dated = F.col("review_count"), F.col("dated_count")
    series = films.select("film_link").join(film_series(reviews), "film_link", "left")
    warning = (
        F.when(total.isNull(), fixed.WARN_NO_REVIEWS)
        .when(total < fixed.TREND_MIN, fixed.WARN_FEW_REVIEWS)
        .when(dated < fixed.TREND_MIN, fixed.WARN_BAD_DATES)
    )
    counted = F.when(
        F.col("warning").isNotNull(), F.when(total < fixed.TREND_MIN, total).otherwise(dated)
    )
    tested = F.col("warning").isNull() & (F.size(xs) >= fixed.TREND_MIN)
    scored = (
        series.withColumn("warning", warning)
        .withColumn("warned_count", counted)
        .withColumn("xs", F.when(tested, xs))
        .withColumn("s", stats.mk_score(F.col("xs")))
        .withColumn("z", stats.mk_z(F.col("s"), stats.mk_variance(F.col("xs"))))
    )
    return scored.select(
        "film_link",
        F.when(F.col("xs").isNotNull(), stats.mk_trend(F.col("z")))
        .otherwise("no trend")
        .alias("trend"),
        F.when(F.col("xs").isNotNull(), stats.two_sided_p(F.col("z"))).alias("p_value"),
        stats.mk_tau(F.col("s"), F.size("xs")).alias("tau"),
        "warning",
        F.col("warned_count").alias("review_count"),
    )


def stale_films(films: DataFrame, trends: DataFrame) -> DataFrame:
    """Films whose stored trend is missing or older than their newest review batch."""
    known = trends.select("film_link", F.col("analysed_on"))
    stale = F.col("analysed_on").isNull() | (
        F.coalesce(F.col("reviews_updated_on") > F.col("analysed_on"), F.lit(False))
    )
    return films.join(known, "film_link", "left").where(stale).select("film_link")


def refresh_trends(films: DataFrame, reviews: DataFrame, trends: DataFrame, now) -> DataFrame:
    """The trend table after recomputing only what is stale.

    Reviews of films that are up to date are dropped before the aggregation. The stale
    films, read three times, are found once and written: keys only.
    """
    stale = written(stale_films(films, trends), "stale-films")
    fresh = film_trends(stale, reviews.join(stale, "film_link", "left_semi")).withColumn(
        "analysed_on", now
    )
    kept = trends.join(stale, "film_link", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))
