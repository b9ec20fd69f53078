"""Column functions on dates; "today" is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DayLike = dt.date | str | Column


def day(value: DayLike) -> Column:
    """A DATE column from a date, an ISO text or a column."""
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)[:10]).cast("date")


def parse_day(c: Column) -> Column:
    """ISO date at the start of a text; NULL when it is none."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def days_since(c: Column, asof: DayLike) -> Column:
    return F.datediff(day(asof), c.cast("date"))


def month_of(c: Column) -> Column:
    return F.trunc(c.cast("date"), "MM")


def period(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def active_flag(released: Column, asof: DayLike, last_day: int) -> Column:
    """1 while at most ``last_day`` days have passed since release, else 0."""
    return F.coalesce((days_since(released, asof) <= last_day).cast("int"), F.lit(0))
