"""CSV inputs: film list, review list, labelled review corpus.

Readers take every column as text; the ``clean_*`` functions do the typing with
casts that give NULL instead of an error, so one bad cell never fails a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, scores, text


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header CSV with every column as STRING.

    Large files are split. Quoted line breaks need ``multiline``, which makes one file
    one task; ``csv_ranges.read_csv_ranges`` splits such files too.
    """
    return (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def clean_films(raw: DataFrame, asof, window_days: int = fixed.WINDOW_DAYS) -> DataFrame:
    """Film rows from the raw film list; rows without a key are dropped."""
    runtime = next((c for c in ("runtime_in_minutes", "runtime") if c in raw.columns), None)
    released = dates.parse_day(F.col("original_release_date"))
    critic = F.col("tomatometer_rating").try_cast("double")
    audience = F.col("audience_rating").try_cast("double")
    typed = raw.select(
        text.blank_to_null(F.col("rotten_tomatoes_link")).alias("film_link"),
        text.blank_to_null(F.col("movie_title")).alias("movie_title"),
        text.blank_to_null(F.col("genres")).alias("genres"),
        text.blank_to_null(F.col("directors")).alias("directors"),
        (F.col(runtime) if runtime else F.lit(None)).try_cast("double").alias("runtime"),
        released.alias("release_date"),
        F.year(released).alias("release_year"),
        critic.alias("critic_score"),
        audience.alias("audience_score"),
        scores.gap(critic, audience).alias("gap"),
        text.blank_to_null(F.col("critics_consensus")).alias("critics_consensus"),
        F.lit("kaggle").alias("source"),
        dates.active_flag(released, asof, window_days).alias("review_fetch_active"),
    )
    return typed.where("film_link IS NOT NULL").withColumn(
        "gap_label", scores.gap_label(F.col("gap"))
    )


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Review rows from the raw review list, with an id made from their content."""
    link = text.strip(F.col("rotten_tomatoes_link"))
    cells = raw.select(
        link.alias("film_link"),
        *(F.col(c) for c in ("critic_name", "publisher_name", "review_date")),
        *(F.col(c) for c in ("review_type", "review_score", "review_content")),
    ).where("film_link <> ''")
    return cells.select(
        "film_link",
        text.empty_to_null(F.col("critic_name")).alias("critic_name"),
        text.empty_to_null(F.col("publisher_name")).alias("publisher_name"),
        dates.parse_day(F.col("review_date")).alias("review_date"),
        text.empty_to_null(F.col("review_type")).alias("review_type"),
        text.empty_to_null(F.col("review_score")).alias("review_score"),
        text.empty_to_null(F.col("review_content")).alias("review_content"),
        F.lit("kaggle").alias("source"),
        text.content_id(
            F.col("film_link"), F.col("critic_name"), F.col("review_date"), F.col("review_content")
        ).alias("external_id"),
    )


def clean_corpus(raw: DataFrame) -> DataFrame:
    """Labelled corpus: 1.0 for a positive row, 0.0 for any other; other columns stay."""
    positive = F.lower(text.strip(F.col("sentiment"))) == "positive"
    return (
        raw.withColumn("label", F.coalesce(positive, F.lit(False)).cast("double"))
        .withColumnRenamed("review", "text")
        .drop("sentiment")
    )


def load_films(spark: SparkSession, path: str, asof, multiline: bool = False) -> DataFrame:
    return clean_films(read_csv(spark, path, multiline), asof)


def load_reviews(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return clean_reviews(read_csv(spark, path, multiline))


def load_corpus(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return clean_corpus(read_csv(spark, path, multiline))
