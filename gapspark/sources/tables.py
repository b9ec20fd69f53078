"""Stored tables: layout on write, plain scans on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark import schemas
from gapspark.functions import dates


def read_films(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FILMS).parquet(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_empty(df: DataFrame) -> bool:
    """Whether a table has no row; stops at the first one found."""
    return df.isEmpty()


def write_films(films: DataFrame, path: str) -> None:
    """A new snapshot. The path must not be one the frame still reads from."""
    films.write.mode("errorifexists").parquet(path)


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Append reviews partitioned by month.

    The rebalance step joins small months and splits a month that holds a large
    share of the rows; rows are sorted by film inside a file, so the min/max
    statistics of a row group let a one-film read skip the rest.
    """
    (
        reviews.withColumn("review_month", dates.period(F.col("review_date")))
        .hint("rebalance", "review_month")
        .sortWithinPartitions("review_month", "film_link")
        .write.mode("append")
        .partitionBy("review_month")
        .parquet(path)
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Model metrics (a handful of rows) as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
