"""The Mann-Kendall trend test as column expressions (no Python per row).

The series of one film is its ordered monthly ratios, so its length is bounded
by the calendar; the pair loop runs inside one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapspark import fixed


def mk_score(xs: Column) -> Column:
    """Sum of sign(later - earlier) over all pairs."""
    per_start = F.transform(
        xs,
        lambda x, i: F.aggregate(
            F.slice(xs, i + 2, F.size(xs)),
            F.lit(0),
            lambda acc, y: acc + F.when(y > x, 1).when(y < x, -1).otherwise(0),
        ),
    )
    return F.aggregate(per_start, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def mk_variance(xs: Column) -> Column:
    """Variance of the score under no trend, corrected for ties."""
    n = F.size(xs).cast("double")
    ties = F.aggregate(
        F.array_distinct(xs),
        F.lit(0.0),
        lambda acc, v: acc + _tie_term(F.size(F.filter(xs, lambda x: x == v)).cast("double")),
    )
    return (_tie_term(n) - ties) / 18


def _tie_term(t: Column) -> Column:
    return t * (t - 1) * (t * 2 + 5)


def mk_z(s: Column, variance: Column) -> Column:
    return (
        F.when(s > 0, F.try_divide(s - 1, F.sqrt(variance)))
        .when(s < 0, F.try_divide(s + 1, F.sqrt(variance)))
        .otherwise(F.lit(0.0))
    )


def mk_tau(s: Column, n: Column) -> Column:
    pairs = n.cast("double") * (n - 1) / 2
    return F.try_divide(s.cast("double"), pairs)


def mk_trend(z: Column) -> Column:
    return (
        F.when(z > fixed.Z_TWO_SIDED_5PCT, "increasing")
        .when(z < -fixed.Z_TWO_SIDED_5PCT, "decreasing")
        .otherwise("no trend")
    )


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) = erfc(|z| / sqrt 2).

    Spark has no error function. Below 2.5 the series with only positive terms is
    summed, above it the continued fraction is folded from its far end; both are
    good to double precision with the step counts used.
    """
    x = F.abs(z) / math.sqrt(2.0)
    return F.when(x < 2.5, 1 - _erf_series(x)).otherwise(_erfc_fraction(x))


def _erf_series(x: Column) -> Column:
    start = F.struct(x.alias("term"), x.alias("total"))
    summed = F.aggregate(
        F.sequence(F.lit(1), F.lit(70)),
        start,
        lambda acc, n: F.struct(
            (acc["term"] * x * x * 2 / (n * 2 + 1)).alias("term"),
            (acc["total"] + acc["term"] * x * x * 2 / (n * 2 + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return summed * F.exp(-x * x) * (2 / math.sqrt(math.pi))


def _erfc_fraction(x: Column) -> Column:
    tail = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)),
        x,
        lambda acc, k: x + k.cast("double") / 2 / acc,
    )
    return F.exp(-x * x) / (tail * math.sqrt(math.pi))
