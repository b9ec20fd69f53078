"""Registered streaming queries: each drains the given files through a stream."""

from pyspark.sql import functions as F

from gapspark import session
from gapspark.functions import text
from gapspark.plans.fixtures import Views
from gapspark.plans.ingest_queries import LINKED, TITLES
from gapspark.plans.registry import query
from gapspark.sources import folders
from gapspark.sources.keyed_log import KeyedLog
from gapspark.streaming import lifecycle, reviews as stream_ops


class StreamViews(Views):
    """The views with one table read as a stream."""

    def __init__(self, v: Views, streamed: str):
        super().__init__(v.spark, v.folder)
        self.streamed = streamed

    def table(self, name: str):
        if name != self.streamed:
            return super().table(name)
        schema = super().table(name).schema
        return stream_ops.read_parquet_stream(
            self.spark, self.folder, schema, f"{name}.parquet"
        )


def review_stream(v):
    return StreamViews(v, "lineitem").plain_reviews.withColumn(
        "ts", stream_ops.event_time(F.col("review_date"))
    )


@query(
    "stream_dedupe",
    ("fx_reviews",),
    "SELECT DISTINCT source, external_id FROM fx_reviews",
)
def _stream_dedupe(v):
    """Keys are remembered for 3000 days, so nearly all are: in files, not in a state store."""
    base = session.fresh_path(v.spark, "dedupe")
    stream = review_stream(v).select("source", "external_id", "ts")
    stream_ops.dedupe_batches(stream, "ts", f"{base}/rows", f"{base}/state", "3000 days").awaitTermination()
    return v.spark.read.parquet(f"{base}/rows").select("source", "external_id")


#: Parts that a registered stream reads one after the other, each in a batch of its own.
PARTS = 4


def landing(v, rows, name: str):
    """A new landing folder for rows like these, and the stream that reads it."""
    folder = session.fresh_path(v.spark, f"{name}-landing")
    folders.create(v.spark, folder)
    return folder, stream_ops.read_parquet_stream(v.spark, folder, rows.schema)


def land_by_days(rows, day, folder: str, run) -> None:
    """Land a table in the order of its days and run the stream after each part."""
    first, last = rows.agg(F.min(day), F.max(day)).first()
    width = max(1, -(-((last - first).days + 1) // PARTS))
    part = F.floor(F.datediff(F.col(day), F.lit(first)) / width)
    stream_ops.land(rows, folder, PARTS, part, run)


def dated_reviews(v):
    rows = v.plain_reviews.select("film_link", "review_type", "review_date")
    return rows.withColumn("ts", stream_ops.event_time(F.col("review_date")))


def closed(v, folder, schema):
    """Adds the closing mark; its film is the empty name, which no film has."""
    stream_ops.close_landing(v.spark, folder, schema, ts=stream_ops.CLOSING, film_link="")


@query(
    "stream_windows",
    ("fx_reviews",),
    """WITH spans AS (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL (floor(
        datediff('day', DATE '1970-01-01', review_date) / 7.0) * 7) DAY AS window_start
      FROM fx_reviews)
    SELECT CAST(window_start AS DATE) AS window_start,
      CAST(window_start + INTERVAL 7 DAY AS DATE) AS window_end,
      count(*) FILTER (lower(trim(review_type)) = 'fresh') AS fresh_count,
      count(*) FILTER (lower(trim(review_type)) = 'rotten') AS rotten_count
    FROM spans GROUP BY window_start""",
)
def _stream_windows(v):
    """Update mode into a keyed table: every window is there, closed or not."""
    rows = dated_reviews(v)
    folder, stream = landing(v, rows, "windows")
    counts = stream_ops.window_counts(stream, "ts")
    base = session.fresh_path(v.spark, "windows")
    log = KeyedLog(v.spark, f"{base}/table", "window_start", overwrite=True)
    log.start(v.spark.createDataFrame([], counts.schema))

    def run() -> None:
        stream_ops.keep_updates(counts, log, f"{base}/state").awaitTermination()

    land_by_days(rows, "review_date", folder, run)
    return log.read().select(
        F.col("window_start").cast("date").alias("window_start"),
        F.col("window_end").cast("date").alias("window_end"),
        "fresh_count",
        "rotten_count",
    )


SESSIONS = """
WITH days AS (SELECT film_link, review_date, count(*) AS n FROM fx_reviews GROUP BY ALL),
starts AS (SELECT *, CASE WHEN review_date <= lag(review_date) OVER (PARTITION BY film_link
    ORDER BY review_date) + 14 THEN 0 ELSE 1 END AS is_start FROM days),
numbered AS (SELECT *, sum(is_start) OVER (PARTITION BY film_link ORDER BY review_date) AS run
  FROM starts),
runs AS (SELECT film_link, min(review_date) AS session_start,
    CAST(max(review_date) + 14 AS DATE) AS session_end, CAST(sum(n) AS BIGINT) AS reviews
  FROM numbered GROUP BY film_link, run)
"""


@query(
    "stream_sessions",
    ("fx_reviews",),
    SESSIONS + "SELECT * FROM runs",
)
def _stream_sessions(v):
    """Open sessions lie in the files of the batch before, not in a state store."""
    rows = dated_reviews(v).drop("review_type")
    folder, stream = landing(v, rows, "sessions")
    base = session.fresh_path(v.spark, "sessions")

    def run() -> None:
        stream_ops.session_batches(stream, "ts", f"{base}/rows", f"{base}/state").awaitTermination()

    land_by_days(rows, "review_date", folder, run)
    closed(v, folder, rows.schema)
    run()
    return stream_ops.closed_sessions(v.spark, f"{base}/rows").where("film_link <> ''").select(
        "film_link",
        F.col("session_start").cast("date").alias("session_start"),
        F.col("session_end").cast("date").alias("session_end"),
        "reviews",
    )


@query(
    "stream_link",
    ("fx_articles", "gx_films"),
    LINKED
    + """SELECT CAST(article_id AS STRING) AS external_id, film_link FROM linked
    WHERE film_link IS NOT NULL""",
)
def _stream_link(v):
    articles = StreamViews(v, "orders").articles.select(
        text.headline_title(F.col("headline")).alias("film_title"),
        F.col("article_id").cast("string").alias("external_id"),
    )
    linked = stream_ops.link_stream(articles, v.gap_films).select("external_id", "film_link")
    rows, _ = stream_ops.run_to_table(v.spark, linked, "linked")
    return v.spark.read.parquet(rows)


@query(
    "stream_upsert",
    ("fx_reviews", "gx_films"),
    """WITH newest AS (SELECT film_link, max(review_date) AS last_review FROM fx_reviews
      GROUP BY film_link)
    SELECT f.film_link, coalesce(n.last_review, f.reviews_updated_on) AS reviews_updated_on,
      f.movie_title FROM gx_films f LEFT JOIN newest n ON f.film_link = n.film_link""",
)
def _stream_upsert(v):
    """Four batches write the films they touch; the log is folded after the second."""
    base = session.fresh_path(v.spark, "upsert")
    log = KeyedLog(v.spark, f"{base}/films", "film_link", ["reviews_updated_on"])
    log.start(v.gap_films.select("film_link", "movie_title", "reviews_updated_on"))
    rows = v.plain_reviews.select("film_link", F.col("review_date").alias("reviews_updated_on"))
    folder, stream = landing(v, rows, "upsert")

    def apply(batch, number: int) -> None:
        log.apply(batch, number, F.col("reviews_updated_on"))
        if number == 1:
            log.compact()

    def run() -> None:
        stream_ops.upsert_batches(stream, apply, f"{base}/state").awaitTermination()

    land_by_days(rows, "reviews_updated_on", folder, run)
    return log.read()


@query(
    "stream_lifecycle",
    ("fx_reviews",),
    """WITH days AS (SELECT DISTINCT film_link, review_date AS day FROM fx_reviews),
    around AS (SELECT *, lag(day) OVER (PARTITION BY film_link ORDER BY day) AS before,
      lead(day) OVER (PARTITION BY film_link ORDER BY day) AS later FROM days)
    SELECT film_link, 'opened' AS event, day AS event_day FROM around
    WHERE before IS NULL OR day - before > 14
    UNION ALL
    SELECT film_link, 'closed', CAST(day + 15 AS DATE) FROM around
    WHERE later - day > 14 OR later IS NULL""",
)
def _stream_lifecycle(v):
    rows = dated_reviews(v)
    folder, stream = landing(v, rows, "lifecycle")
    base = session.fresh_path(v.spark, "lifecycle")
    with session.setting(v.spark, session.STATE_STORE, lifecycle.STATE_PROVIDER):
        events = lifecycle.window_events(lifecycle.review_days(stream, "ts"))

        def run() -> None:
            stream_ops.run_to_table(v.spark, events, "lifecycle", base=base)

        land_by_days(rows, "review_date", folder, run)
        closed(v, folder, rows.schema)
        run()
    return v.spark.read.parquet(f"{base}/rows").where("film_link <> ''")


EVENT_KEYS = ["user_id", "event_type"]


@query(
    "stream_bursts",
    (),
    """WITH marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS is_first
      FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(is_first) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS burst FROM marked)
    SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS copies
    FROM numbered GROUP BY user_id, event_type, burst""",
)
def _stream_bursts(v):
    """Copies within six hours fall away; the run stops after every batch and goes on from
    its checkpoint."""
    rows = v.table("events").select("event_id", *EVENT_KEYS, F.col("ts").cast("timestamp").alias("ts"))
    folder = session.fresh_path(v.spark, "bursts")
    state, found = f"{folder}/state", f"{folder}/rows"
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    width = max(1.0, (last - first).total_seconds() / PARTS)
    seconds = F.unix_micros("ts") - F.unix_micros(F.lit(first))
    part = F.least(F.floor(seconds / (1e6 * width)), F.lit(PARTS - 1))
    for i in range(PARTS + 1):
        if i < PARTS:
            rows.where(part == i).write.mode("append").parquet(f"{folder}/landing")
        else:
            stream_ops.close_landing(v.spark, f"{folder}/landing", rows.schema, ts=stream_ops.CLOSING, event_type="")
        stream = stream_ops.read_parquet_stream(v.spark, f"{folder}/landing", rows.schema)
        bursts = stream_ops.first_of_bursts(stream, "ts", EVENT_KEYS, ["event_id"], "6 hours")
        writer = bursts.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        writer.start(found).awaitTermination()
    return v.spark.read.parquet(found).where("event_type <> ''").select(*EVENT_KEYS, "event_id", "copies")


@query(
    "stream_late_rows",
    (),
    """WITH parted AS (SELECT ts, event_id % 4 AS part FROM events),
    landed AS (SELECT *, CASE WHEN part = 3 THEN 0 ELSE part + 1 END AS batch FROM parted),
    tops AS (SELECT batch, max(ts) AS newest FROM landed GROUP BY batch)
    SELECT CAST(l.batch AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (ts < (SELECT max(newest) FROM tops t
        WHERE t.batch < l.batch) - INTERVAL 10 DAY) AS late FROM landed l GROUP BY l.batch""",
)
def _stream_late_rows(v):
    """Files that each span the whole month, so most of a later file's rows are late."""
    rows = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = session.fresh_path(v.spark, "late")
    landed, stream = landing(v, rows, "late")

    def run() -> None:
        stream_ops.late_split(stream, "ts", f"{folder}/split", f"{folder}/state", "10 days").awaitTermination()

    stream_ops.land(rows, landed, PARTS, (F.col("event_id") + 1) % PARTS, run)
    return stream_ops.late_counts(v.spark, f"{folder}/split").select("batch", "rows", "late")


@query(
    "stream_link_index",
    ("fx_articles", "gx_films"),
    "WITH"
    + TITLES
    + """,
    known AS (SELECT 1 AS half, lower(movie_title) AS k, film_link FROM gx_films UNION ALL
      SELECT 0, lower(movie_title), film_link FROM gx_films WHERE film_id % 2 = 0),
    idx AS (SELECT half, k, min(film_link) AS film_link FROM known WHERE k IS NOT NULL GROUP BY half, k),
    asked AS (SELECT *, CASE WHEN article_id % 4 >= 2 THEN 1 ELSE 0 END AS half FROM titles WHERE film_title <> '')
    SELECT CAST(article_id AS STRING) AS external_id, coalesce(a.film_link, b.film_link) AS film_link FROM asked t
    LEFT JOIN idx a ON lower(film_title) = a.k AND a.half = t.half
    LEFT JOIN idx b ON strpos(film_title, ':') > 0 AND lower(trim(string_split(film_title, ':')[1])) = b.k AND b.half = t.half
    WHERE coalesce(a.film_link, b.film_link) IS NOT NULL""",
)
def _stream_link_index(v):
    """The first half of the files is linked to the even films only, then the odd ones are
    published: a film added between two batches links in the next."""
    titled = v.articles.select(
        text.headline_title(F.col("headline")).alias("film_title"), F.col("article_id"),
    )
    folder = session.fresh_path(v.spark, "linked")
    films = v.gap_films.select("film_link", "movie_title", "film_id")
    index = stream_ops.TitleIndex(v.spark, f"{folder}/index")
    landed, stream = landing(v, titled, "linked")

    def run() -> None:
        stream_ops.link_batches(stream, index, f"{folder}/rows", f"{folder}/state").awaitTermination()

    for half, known in enumerate((films.where("film_id % 2 = 0"), films)):
        index.publish(known)
        part = F.col("article_id") % PARTS - 2 * half
        stream_ops.land(titled, landed, 2, part, run)
    rows = v.spark.read.parquet(f"{folder}/rows")
    return rows.select(F.col("article_id").cast("string").alias("external_id"), "film_link")
