"""Reviews as a stream: de-duplication, linkage, windows, sessions, upserts.

Event time columns must be TIMESTAMP; ``event_time`` converts dates and
timestamps without a zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapspark import session
from gapspark.functions import text
from gapspark.operators import link, merge
from gapspark.sources import folders
from gapspark.sources.keyed_log import KeyedLog


def event_time(c: Column) -> Column:
    return c.cast("timestamp")


def read_parquet_stream(
    spark: SparkSession, folder: str, schema, name_glob: str | None = None, files: int | None = None
) -> DataFrame:
    """Parquet files arriving in a folder, at most ``files`` per micro-batch."""
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def dedupe(
    stream: DataFrame,
    ts: str,
    delay: str = "1 day",
    keys: tuple[str, ...] = ("source", "external_id"),
    salts: int = 8,
) -> DataFrame:
    """The first row of every key; a key is remembered for the delay.

    A stream has no map-side step here, so all copies of a key would meet in one
    task. They are therefore reduced in ``salts`` parts first, by the task that
    read them, and the survivors of the parts once more (0: in one step).
    """
    marked = stream.withWatermark(ts, delay)
    if salts:
        parted = marked.withColumn("_salt", F.spark_partition_id() % salts)
        marked = parted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark(list(keys))


def dedupe_batches(
    stream: DataFrame, ts: str, folder: str, checkpoint: str, delay: str = "1 day",
    keys: tuple[str, ...] = ("source", "external_id"),
) -> StreamingQuery:
    """The first row of every key into ``folder``, batch by batch; for delays that keep more
    keys than a state store holds in memory.

    What is remembered is the rows written before: of a batch, the first row of a key by
    event time stays, unless a row of the key was kept that is at most the delay older.
    Copies are reduced in every task before the one shuffle, so no key is hot; a batch
    costs its own rows and a pass over the keys and times kept. Null keys are equal, a
    null event time is within any delay. A repeated batch reads only the batches before
    its number and writes the same rows again.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        firsts = merge.first_per_key(batch, list(keys), [ts])
        done = [n for n in folders.finished(spark, folder, "batch") if n < number]
        if done:
            reader = batch.sparkSession.read.schema(batch.schema)
            kept = reader.parquet(*[f"{folder}/batch={n}" for n in done])
            kept = kept.select(F.col(ts).alias("__ts"), *[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)])
            same = F.coalesce(F.col("__ts") >= F.col(ts) - F.expr(f"INTERVAL {delay}"), F.lit(True))
            for i, k in enumerate(keys):
                same &= F.col(k).eqNullSafe(F.col(f"__{i}"))
            firsts = firsts.join(kept, same, "left_anti")
        firsts.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return upsert_batches(stream, apply, checkpoint)


def link_stream(articles: DataFrame, films: DataFrame, title: str = "film_title") -> DataFrame:
    """Articles of a stream with the film their title names; others are dropped.

    The stream joins the title index twice, full title and short title, instead
    of being aggregated first: a stream cannot take its distinct titles in append
    mode.
    """
    index = link.title_index(films)
    by_short = index.select(
        F.col("title_key").alias("_short"), F.col("film_link").alias("_short_link")
    )
    keyed = articles.withColumns(
        {"title_key": F.lower(title), "_short": F.lower(text.main_title(F.col(title)))}
    )
    return (
        keyed.join(index, "title_key", "left")
        .join(by_short, "_short", "left")
        .withColumn("film_link", F.coalesce("film_link", "_short_link"))
        .where(F.col("film_link").isNotNull() & (F.col(title) != ""))
        .drop("title_key", "_short", "_short_link")
    )


def window_counts(
    stream: DataFrame, ts: str, width: str = "7 days", slide: str | None = None,
    delay: str = "1 day", watermark: bool = True,
) -> DataFrame:
    """Fresh and rotten counts per time window (tumbling, or sliding by ``slide``)."""
    kind = F.col("review_type")
    source = stream.withWatermark(ts, delay) if watermark else stream
    spans = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        source.groupBy(spans.alias("span"))
        .agg(
            F.count_if(text.is_type(kind, "Fresh")).alias("fresh_count"),
            F.count_if(text.is_type(kind, "Rotten")).alias("rotten_count"),
        )
        .select(
            F.col("span.start").alias("window_start"),
            F.col("span.end").alias("window_end"),
            "fresh_count",
            "rotten_count",
        )
    )


def activity_sessions(
    stream: DataFrame, ts: str, gap: str | Column = "14 days", delay: str = "1 day", watermark: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Runs of reviews per film with no pause as long as ``gap``; a row counts for as many
    reviews as its ``weight`` column says (None: for one).

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    on, runs are merged before the shuffle, so a film with very many reviews
    sends few rows.
    """
    source = stream.withWatermark(ts, delay) if watermark else stream
    return (
        source.groupBy("film_link", F.session_window(ts, gap).alias("span"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("reviews"))
        .select(
            "film_link",
            F.col("span.start").alias("session_start"),
            F.col("span.end").alias("session_end"),
            "reviews",
        )
    )


#: Columns of the sessions that ``session_batches`` writes.
SESSIONS = "film_link string, session_start timestamp, session_end timestamp, reviews long"


def _sessions(spark: SparkSession, folder: str, number: int, gap: str, delay: str) -> tuple[DataFrame, Column | None]:
    """The sessions of a batch and the time up to which they are closed (None: no row yet).

    The newest event ends the session that ends last, which is open and so in every batch.
    """
    sessions = spark.read.schema(SESSIONS).parquet(f"{folder}/batch={number}")
    newest = F.max("session_end") - F.expr(f"INTERVAL {gap}")
    upto = sessions.agg(F.unix_micros(newest - F.expr(f"INTERVAL {delay}"))).first()[0]
    return sessions, None if upto is None else F.timestamp_micros(F.lit(upto))


def closed_sessions(spark: SparkSession, folder: str, gap: str = "14 days", delay: str = "1 day") -> DataFrame:
    """What ``session_batches`` has closed below a folder, with the same gap and delay."""
    found = spark.createDataFrame([], SESSIONS)
    for number in folders.finished(spark, folder, "batch"):
        sessions, upto = _sessions(spark, folder, number, gap, delay)
        if upto is not None:
            found = found.unionByName(sessions.where(F.col("session_end") <= upto))
    return found


def session_batches(
    stream: DataFrame, ts: str, folder: str, checkpoint: str, gap: str = "14 days", delay: str = "1 day"
) -> StreamingQuery:
    """``activity_sessions`` batch by batch into ``folder``; for batches of more sessions than
    a state store holds in memory. ``closed_sessions`` reads what is closed.

    A batch merges its rows with the sessions that the batch before left open, and writes
    both. As in a state store, a session is closed when the newest event time so far, less
    the delay, is past its end, and what comes later than that is left out. A batch costs
    its own rows and the open sessions. A null event time is in no session; a repeated batch
    reads only the batches before its number and writes the same rows again.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        session_of_batch = batch.sparkSession
        rows = batch.select("film_link", F.col(ts).alias("ts"), F.lit(gap).cast("interval").alias("gap"), F.lit(1).cast("long").alias("reviews"))
        done = [n for n in folders.finished(spark, folder, "batch") if n < number]
        upto = None
        if done:
            sessions, upto = _sessions(session_of_batch, folder, done[-1], gap, delay)
            micros = F.unix_micros("session_end") - F.unix_micros("session_start")
            length = F.make_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
            still = sessions.where(F.col("session_end") > upto)
            rows = rows.unionByName(still.select("film_link", F.col("session_start").alias("ts"), length.alias("gap"), "reviews"))
        merged = activity_sessions(rows, "ts", F.col("gap"), watermark=False, weight="reviews")
        if upto is not None:
            merged = merged.where(F.col("session_end") > upto)
        merged.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return upsert_batches(stream, apply, checkpoint)


def upsert_batches(
    stream: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``apply`` on every micro-batch; it must give the same result when repeated."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def snapshot_upsert(spark: SparkSession, base: str, key: str, order: Column, columns: list[str]):
    """A batch function that upserts into numbered snapshots below ``base``.

    Batch n reads snapshot n and writes n + 1, so a repeated batch rewrites the
    same folder and nothing is applied twice.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        session_of_batch = batch.sparkSession
        stored = session_of_batch.read.parquet(f"{base}/{batch_id}")
        incoming = merge.collapse_updates(batch, key, order, columns)
        merged = merge.upsert(stored, incoming, key, columns)
        merged.write.mode("overwrite").parquet(f"{base}/{batch_id + 1}")

    return apply


def run_to_table(
    spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", base: str | None = None
) -> tuple[str, StreamingQuery]:
    """Drain what is available into a Parquet table in the shared folder: a new one, or the
    one below ``base``, which goes on from its checkpoint."""
    base = base or session.fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start(f"{base}/rows")
    )
    query.awaitTermination()
    return f"{base}/rows", query


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far, over all stateful operators."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


# --- streams that end complete -----------------------------------------------

#: Event time of the closing mark: later than any watermark of real rows.
CLOSING = "2999-12-31 00:00:00"


def land(df: DataFrame, folder: str, parts: int, part: Column, run: Callable[[], object]) -> None:
    """Write a table to a landing folder in ``parts`` parts, one after the other, and after
    each ``run`` the stream that reads the folder, so that a part is a batch of its own;
    ``part`` gives a row's part, from 0.

    A part is as many files as the table has partitions with rows of it: no task writes or
    reads more than the scan of the table itself deals out.
    """
    for i in range(parts):
        df.where(part == i).write.mode("append").parquet(folder)
        run()


def close_landing(spark: SparkSession, folder: str, schema, **values) -> None:
    """Add the closing mark to a landing folder: a row without content, late enough to
    move the watermark past every window, session and timer that is still open. ``values``
    name what the row holds besides (its event time among them)."""
    fields = [F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*fields).coalesce(1).write.mode("append").parquet(folder)


def keep_updates(
    stream: DataFrame, log: KeyedLog, checkpoint: str, order: Column | None = None, files: int | None = None
) -> StreamingQuery:
    """Write what a stream in update mode changed into a keyed table, batch by batch.

    The table holds every group at any time, also those the watermark has not closed.
    """
    def apply(batch: DataFrame, number: int) -> None:
        log.apply(batch, number, order)

    writer = stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def first_of_bursts(stream: DataFrame, ts: str, keys: list[str], order: list[str], delay: str = "1 day") -> DataFrame:
    """The first row of every burst of copies: rows of a key with no pause as long as the
    delay. A copy inside the delay falls away, one beyond it stays.

    The row that stays is the first by event time and then by ``order``, whichever batch
    or task saw it. A key is remembered until the watermark passes its last row by the
    delay, over batches and restarts; copies are reduced in every task before the shuffle.
    A row leaves once its burst is closed.
    """
    names = [c for c in stream.columns if c not in keys]
    first = F.min_by(F.struct(*names), F.struct(ts, *order)).alias("_row")
    bursts = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, delay).alias("_span"))
    return bursts.agg(first, F.count("*").alias("copies")).select(*keys, "_row.*", "copies")


# --- late rows ---------------------------------------------------------------


def late_split(
    stream: DataFrame, ts: str, folder: str, checkpoint: str, delay: str = "1 day"
) -> StreamingQuery:
    """Part a stream into rows in time and late rows, and count both in a table.

    A row is late when its event time is before the watermark its batch started with:
    the greatest event time of the batches before, less the delay. Every batch writes
    ``rows`` and ``counts`` under its number (a repeated batch writes the same), so the
    counts are whole however many batches there were. Null event times are in time.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        session_of_batch = batch.sparkSession
        done = [n for n in folders.finished(spark, f"{folder}/counts", "batch") if n < number]
        mark = F.lit(None).cast("timestamp")
        if done:
            counts = session_of_batch.read.parquet(*[f"{folder}/counts/batch={n}" for n in done])
            newest = counts.agg(F.max("newest")).first()[0]
            if newest is not None:
                mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(ts) < mark, F.lit(False))
        target = f"{folder}/rows/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(target)
        written = session_of_batch.read.schema(f"{ts} timestamp, late boolean").parquet(target)
        counts = written.agg(F.count("*").alias("rows"), F.count_if("late").alias("late"), F.max(ts).alias("newest"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return upsert_batches(stream, apply, checkpoint)


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, late, newest) of every batch that ``late_split`` finished."""
    found = folders.finished(spark, f"{folder}/counts", "batch")
    parts = [spark.read.parquet(f"{folder}/counts/batch={n}").withColumn("batch", F.lit(n).cast("long")) for n in found]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("batch", "rows", "late", "newest")


# --- linkage to a versioned title index --------------------------------------


class TitleIndex:
    """Titles and their films, stored in versions; a stream takes the newest per batch.

    A version holds (title_key, film_link), the lowest film key of every title. It is
    written once and read as often as there are batches.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def publish(self, films: DataFrame) -> int:
        """Store a new version; batches that start from now on use it."""
        number = (folders.finished(self.spark, self.folder, "version") or [-1])[-1] + 1
        link.title_index(films).write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        return number

    def newest(self) -> DataFrame:
        number = folders.finished(self.spark, self.folder, "version")[-1]
        return self.spark.read.parquet(f"{self.folder}/version={number}")


def link_by_index(articles: DataFrame, index: DataFrame, title: str = "film_title") -> DataFrame:
    """Articles with the film their title names, by one join; others are dropped.

    Distinct titles ask with two keys, the full title and the part before its colon; the
    answers of both come from the same join and the full title's wins.
    """
    asked = articles.where(F.col(title) != "").select(F.col(title).alias("_title")).distinct()
    keys = F.filter(F.array(F.lower("_title"), F.lower(text.main_title(F.col("_title")))), lambda k: k.isNotNull())
    unpivoted = asked.select("_title", F.posexplode(keys).alias("_place", "title_key"))
    found = unpivoted.join(index, "title_key").groupBy("_title").agg(F.min_by("film_link", "_place").alias("film_link"))
    return articles.join(found, F.col(title) == F.col("_title")).drop("_title")


def link_batches(
    articles: DataFrame, index: TitleIndex, folder: str, checkpoint: str, title: str = "film_title"
) -> StreamingQuery:
    """Link a stream batch by batch to the newest index; rows go to a folder per batch."""
    def apply(batch: DataFrame, number: int) -> None:
        linked = link_by_index(batch, index.newest(), title)
        linked.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return upsert_batches(articles, apply, checkpoint)
