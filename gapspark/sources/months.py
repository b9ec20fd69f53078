"""Month partitions between two days, for landing folders read month by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.functions import dates


def month_partitions(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row per calendar month touched by a span, the last one cut at its end.

    ``spans`` keeps its columns; month_start and month_end are added.
    """
    months = F.sequence(dates.month_of(start), end.cast("date"), F.expr("interval 1 month"))
    return spans.withColumn("month_start", F.explode(months)).withColumn(
        "month_end", F.least(F.last_day("month_start"), end.cast("date"))
    )
