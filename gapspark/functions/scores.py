"""Column functions on scores: gap, labels, stars, score payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapspark import fixed


def gap(critic: Column, audience: Column, digits: int | None = None) -> Column:
    """Critic minus audience; NULL if either is missing."""
    diff = critic - audience
    return diff if digits is None else F.bround(diff, digits)


def gap_label(g: Column) -> Column:
    return (
        F.when(g > fixed.GAP_BOUND, fixed.LABEL_CRITICS)
        .when(g < -fixed.GAP_BOUND, fixed.LABEL_AUDIENCE)
        .otherwise(fixed.LABEL_ALIGNED)
    )


def gap_badge(g: Column) -> Column:
    """Side named on a browse card; NULL without a gap."""
    return F.when(
        g.isNotNull(),
        F.when(g > fixed.BADGE_BOUND, "critics")
        .when(g < -fixed.BADGE_BOUND, "audience")
        .otherwise("aligned"),
    )


def direction(g: Column) -> Column:
    return F.when(g < 0, "audience_higher").otherwise("critic_higher")


def whole(c: Column) -> Column:
    """Rounded half to even, as an integer."""
    return F.bround(c, 0).cast("int")


def gap_points(g: Column) -> Column:
    return F.abs(whole(g))


def percent(part: Column, total: Column) -> Column:
    return whole(F.try_divide(part * F.lit(100.0), total))


def bar_width(value: Column, widest: Column) -> Column:
    """Length of a chart bar in percent of the widest one, halves rounded up."""
    scale = F.when(widest == 0, F.lit(1.0)).otherwise(widest)
    return F.floor(F.abs(value) / scale * 100 + F.lit(0.5)).cast("int")


def stars_to_type(stars: Column) -> Column:
    """No stars or three and more count as Fresh."""
    missing = stars.isNull() | (stars == "")
    return F.when(missing | (stars.try_cast("double") >= 3), "Fresh").otherwise("Rotten")


def stars_to_sentiment(stars: Column) -> Column:
    return (
        F.when(stars <= 2, "Negative").when(stars == 3, "Neutral").otherwise("Positive")
    )


def probability_to_stars(p: Column) -> Column:
    """Five equal bands of the positive probability."""
    return F.least(F.floor(p * 5) + 1, F.lit(5)).cast("int")


def critic_percent(ratings: Column) -> Column:
    """First readable percentage of the critic source in a ratings array."""
    own = F.filter(ratings, lambda r: r["Source"] == fixed.CRITIC_SOURCE)
    numbers = F.transform(own, lambda r: F.replace(r["Value"], F.lit("%"), F.lit("")).try_cast("double"))
    return F.get(F.filter(numbers, lambda n: n.isNotNull()), F.lit(0))


def audience_proxy(rating: Column) -> Column:
    """A ten-point rating text as a percentage; NULL when it is not a number."""
    return F.bround(rating.try_cast("double") * 10, 1)
