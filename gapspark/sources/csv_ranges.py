"""CSV files with quoted line breaks, read as many tasks per file.

Spark can split a text file anywhere, but whether a line break ends a record depends on
the quotes before it. A record ends where their number is even, so each byte range
only has to tell whether its own number of quotes is odd. A prefix over the ranges of a
file gives the state each range starts in; after that every range knows by itself
where records begin. Texts are shuffled twice: lines by range, pieces by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapspark.sources.csv_files import read_csv

RANGE = ("file", "range_start")


def odd_quotes(line: Column) -> Column:
    """1 for a line with an odd number of quotes, else 0."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the range they were read in and their place in it.

    ``odd`` is 1 where the quotes of the range before the line are odd in number.
    Carriage returns stay; the number of a line only orders it inside its range.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range_start"),
        F.monotonically_increasing_id().alias("place"),
    )
    before = Window.partitionBy(*RANGE).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    quotes = raw.withColumn("quotes", odd_quotes(F.col("line")))
    return quotes.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)


def range_states(lines: DataFrame) -> DataFrame:
    """Per range: whether it starts inside quotes, and the record that is open there.

    One row per range reaches the prefix, which runs per file. ``open`` is the
    last record that began in an earlier range, ``head`` the first line of the file that
    is not blank, where its header begins. A file whose quotes are odd in number as a
    whole raises an error: its records cannot be told.
    """
    last = {odd: F.max(F.when(F.col("odd") == odd, F.col("place"))) for odd in (0, 1)}
    ranges = lines.groupBy(*RANGE).agg(
        (F.sum("quotes") % 2).alias("total"),
        last[0].alias("last_0"),
        last[1].alias("last_1"),
        F.min(F.when(~F.col("line").isin("", "\r"), F.struct(F.col("range_start").alias("start"), "place"))).alias("first_line"),
    )
    whole = Window.partitionBy("file")
    before = whole.orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("state", F.coalesce(F.sum("total").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("last", F.when(F.col("state") == 0, F.col("last_0")).otherwise(F.col("last_1")))
    began = F.when(F.col("last").isNotNull(), F.struct(F.col("range_start").alias("start"), F.col("last").alias("place")))
    broken = F.sum("total").over(whole) % 2 == 1
    message = F.concat(F.lit("the quotes of a file do not pair up: "), F.col("file"))
    return ranges.select(
        *RANGE,
        F.when(broken, F.raise_error(message).cast("bigint")).otherwise(F.col("state")).alias("state"),
        F.last(began, ignorenulls=True).over(before).alias("open"),
        F.min("first_line").over(whole).alias("head"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, record: the text of every record but the headers and blank ones.

    The lines of a record are joined again wherever they were read; a record may span
    any number of ranges.
    """
    lines = lines_of(spark, path)
    placed = lines.join(range_states(lines), list(RANGE))
    here = F.when(F.col("odd") == F.col("state"), F.struct(F.col("range_start").alias("start"), F.col("place").alias("place")))
    so_far = Window.partitionBy(*RANGE).orderBy("place")
    owner = F.coalesce(F.last(here, ignorenulls=True).over(so_far), F.col("open"))
    pieces = (
        placed.withColumn("owner", owner)
        .where("owner <> head")
        .groupBy("file", "range_start", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
        .select("file", "owner", "range_start", F.array_join("lines.line", "\n").alias("text"))
    )
    joined = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("range_start", "text"))).alias("parts"))
    text = F.regexp_replace(F.array_join("parts.text", "\n"), "\r$", "")
    return joined.select("file", text.alias("record")).where("record <> ''")


def read_csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted line breaks, every column as STRING, many tasks per file.

    Gives the rows of ``read_csv(..., multiline=True)`` for files whose quotes follow the
    usual rules: fields with quotes, commas or line breaks are quoted, quotes inside
    are doubled. Ranges follow ``spark.sql.files.maxPartitionBytes``. All files have the
    header of the first; empty files give no row; compressed files are one range each.
    """
    names = read_csv(spark, path, multiline=True).columns
    fields = [f"`{n.replace('`', '``')}` STRING" for n in names]
    parsed = F.from_csv("record", F.lit(", ".join(fields)), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records(spark, path).select(parsed.alias("row")).select("row.*")
