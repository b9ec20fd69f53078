"""Registered queries over keyed writes: de-duplication, insert-ignore, upsert, updates."""

from pyspark.sql import functions as F

from gapspark.functions import scores, text
from gapspark.operators import merge
from gapspark.plans.fixtures import ASOF
from gapspark.plans.registry import query
from gapspark.sources import documents, months

TIES = "review_date, critic_name, review_type, review_content"


def ties():
    return TIES.split(", ")


@query(
    "review_dedupe",
    ("fx_reviews",),
    f"""SELECT source, external_id, film_link, critic_name, review_date, review_type FROM (
      SELECT *, row_number() OVER (PARTITION BY source, external_id
        ORDER BY film_link, {TIES}) AS place FROM fx_reviews) WHERE place = 1""",
)
def _review_dedupe(v):
    """The text orders last: it only chooses between rows that are equal in what is returned,
    so it does not travel."""
    asked = ["source", "external_id", "film_link", "critic_name", "review_date", "review_type"]
    order = ["film_link", *(c for c in ties() if c in asked)]
    return merge.first_per_key(v.reviews.select(*asked), ["source", "external_id"], order)


# A batch that holds everything again, with no id where the verdict is unknown.
BATCH = """
WITH incoming AS (
  SELECT film_link, critic_name, review_date, review_type, review_content, source,
    CASE WHEN review_type <> 'n/a' THEN external_id END AS external_id FROM fx_reviews),
stored AS (SELECT * FROM incoming WHERE review_date < DATE '1999-01-01'),
"""


def batch(v):
    return v.reviews.select(
        "film_link",
        "critic_name",
        "review_date",
        "review_type",
        "review_content",
        "source",
        F.when(F.col("review_type") != "n/a", F.col("external_id")).alias("external_id"),
    )


@query(
    "insert_ignore",
    ("fx_reviews",),
    BATCH
    + f"""firsts AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY film_link, source, external_id
        ORDER BY {TIES}) AS place FROM incoming WHERE external_id IS NOT NULL) WHERE place = 1),
    added AS (
      SELECT f.* EXCLUDE (place) FROM firsts f
      WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.film_link = f.film_link
        AND s.source = f.source AND s.external_id = f.external_id)
      UNION ALL BY NAME SELECT * FROM incoming WHERE external_id IS NULL)
    SELECT film_link, source, external_id, review_date, critic_name
    FROM (SELECT * FROM stored UNION ALL BY NAME SELECT * FROM added)""",
)
def _insert_ignore(v):
    incoming = batch(v)
    stored = incoming.where(F.col("review_date") < "1999-01-01")
    table = merge.insert_ignore(stored, incoming, ["film_link", "source", "external_id"], ties())
    return table.select("film_link", "source", "external_id", "review_date", "critic_name")


@query(
    "insert_ignore_films",
    ("gx_films",),
    """SELECT film_link, CASE WHEN source = 'kaggle' THEN movie_title ELSE upper(movie_title) END
      AS movie_title, source FROM gx_films""",
)
def _insert_ignore_films(v):
    columns = ["film_link", "movie_title", "source"]
    stored = v.gap_films.where("source = 'kaggle'").select(*columns)
    shouted = v.gap_films.select(*columns).withColumn("movie_title", F.upper("movie_title"))
    return merge.insert_ignore(stored, shouted, ["film_link"], [F.col("movie_title")])


PAYLOADS = r"""
WITH answers AS (
  SELECT imdb_id,
    TRY_CAST(nullif(regexp_extract(payload, '"Source":"Rotten Tomatoes","Value":"(\d+)%"', 1), '')
      AS DOUBLE) AS critic_score,
    round_even(TRY_CAST(nullif(regexp_extract(payload, '"imdbRating":"([^"]*)"', 1), '')
      AS DOUBLE) * 10, 1) AS audience_proxy
  FROM fx_scores WHERE payload LIKE '%"Response":"True"%')
"""


def answers(v):
    return documents.parse_scores(v.score_payloads)


@query(
    "upsert_scores",
    ("gx_films", "fx_scores"),
    PAYLOADS
    + """,
    stored AS (SELECT film_link, movie_title, critic_score, audience_score, gap, gap_label
      FROM gx_films WHERE source <> 'tmdb'),
    incoming AS (SELECT film_link, upper(movie_title) AS movie_title, a.critic_score,
        a.audience_proxy AS audience_score,
        round_even(a.critic_score - a.audience_proxy, 2) AS gap
      FROM gx_films f JOIN answers a ON f.imdb_id = a.imdb_id),
    merged AS (SELECT coalesce(o.film_link, n.film_link) AS film_link,
        CASE WHEN o.film_link IS NOT NULL THEN o.movie_title ELSE n.movie_title END AS movie_title,
        coalesce(n.critic_score, o.critic_score) AS critic_score,
        coalesce(n.audience_score, o.audience_score) AS audience_score,
        coalesce(n.gap, o.gap) AS gap
      FROM stored o FULL JOIN incoming n ON o.film_link = n.film_link)
    SELECT film_link, movie_title, critic_score, round(audience_score, 6) AS audience_score,
      round(gap, 6) AS gap,
      CASE WHEN gap > 20 THEN 'Critics loved it, audiences didn''t'
           WHEN gap < -20 THEN 'Audiences loved it, critics didn''t' ELSE 'Aligned' END AS gap_label
    FROM merged""",
)
def _upsert_scores(v):
    films = v.gap_films.select(
        "film_link", "movie_title", "critic_score", "audience_score", "gap", "gap_label",
        "source", "imdb_id",
    )
    incoming = (
        films.select("film_link", F.upper("movie_title").alias("movie_title"), "imdb_id")
        .join(answers(v).withColumnRenamed("audience_proxy", "audience_score"), "imdb_id")
        .withColumn("gap", scores.gap(F.col("critic_score"), F.col("audience_score"), 2))
        .withColumn("gap_label", scores.gap_label(F.col("gap")))
        .drop("imdb_id")
    )
    stored = films.where("source <> 'tmdb'").drop("source", "imdb_id")
    merged = merge.upsert_films(stored, incoming)
    return merged.withColumns(
        {c: F.round(c, 6) for c in ("audience_score", "gap")}
    )


@query(
    "keyed_updates",
    ("gx_films", "fx_articles"),
    f"""WITH seen AS (
      SELECT 'm/' || CAST(article_id % 200 AS STRING) AS film_link, max(published) AS newest
      FROM fx_articles GROUP BY 1)
    SELECT f.film_link,
      CASE WHEN s.film_link IS NOT NULL THEN 1 ELSE review_fetch_active END AS review_fetch_active,
      CASE WHEN s.film_link IS NOT NULL THEN NULL ELSE last_fetched_on END AS last_fetched_on,
      coalesce(CASE WHEN newest >= DATE '2001-01-01' THEN newest END, reviews_updated_on)
        AS reviews_updated_on
    FROM gx_films f LEFT JOIN seen s ON f.film_link = s.film_link""",
)
def _keyed_updates(v):
    newest = F.max("published")
    updates = (
        v.articles.groupBy(
            F.concat(F.lit("m/"), (F.col("article_id") % 200).cast("string")).alias("film_link")
        )
        .agg(F.when(newest >= "2001-01-01", newest).alias("reviews_updated_on"))
        .withColumn("review_fetch_active", F.lit(1))
        .withColumn("last_fetched_on", F.lit(None).cast("date"))
    )
    base = v.gap_films.select(
        "film_link", "review_fetch_active", "last_fetched_on", "reviews_updated_on"
    )
    return merge.merge_updates(
        base,
        updates,
        "film_link",
        overwrite=["review_fetch_active", "last_fetched_on"],
        fill=["reviews_updated_on"],
    )


@query(
    "repeated_updates",
    ("fx_reviews",),
    """SELECT film_link, arg_min(source, external_id) AS source,
      arg_max(review_type, external_id) FILTER (review_type IS NOT NULL) AS review_type
    FROM (SELECT film_link, source, nullif(review_type, 'n/a') AS review_type,
            external_id || '/' || critic_name || '/' || CAST(review_date AS STRING) || review_content
            || review_type || source AS external_id
          FROM fx_reviews) GROUP BY film_link""",
)
def _repeated_updates(v):
    written = v.reviews.select(
        "film_link",
        "source",
        F.nullif("review_type", F.lit("n/a")).alias("review_type"),
        F.concat(
            F.concat_ws("/", "external_id", "critic_name", F.col("review_date").cast("string")),
            "review_content",
            "review_type",
            "source",
        ).alias("moment"),
    )
    collapsed = merge.collapse_updates(written, "film_link", F.col("moment"), ["review_type"])
    return collapsed.drop("moment")


@query(
    "content_id",
    ("fx_reviews",),
    """SELECT film_link, external_id, left(sha1(film_link || '|' || coalesce(critic_name, '') || '|'
      || coalesce(CAST(review_date AS STRING), '') || '|' || coalesce(review_content, '')),
      20) AS content_id FROM fx_reviews""",
)
def _content_id(v):
    day = F.col("review_date").cast("string")
    made = text.content_id(
        F.col("film_link"), F.col("critic_name"), day, F.col("review_content")
    )
    return v.reviews.select("film_link", "external_id", made.alias("content_id"))


@query(
    "month_partitions",
    ("fx_articles",),
    f"""WITH spans AS (SELECT source, min(published) AS first_day FROM fx_articles GROUP BY source),
    months AS (SELECT source, CAST(unnest(generate_series(date_trunc('month', first_day),
        CAST(DATE '{ASOF}' AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM spans),
    ends AS (SELECT source, month_start, least(last_day(month_start), DATE '{ASOF}') AS month_end
      FROM months)
    SELECT e.source, month_start, month_end, count(article_id) AS articles
    FROM ends e LEFT JOIN fx_articles a ON a.source = e.source
      AND a.published BETWEEN month_start AND month_end
    GROUP BY ALL""",
)
def _month_partitions(v):
    asof = F.lit(ASOF).cast("date")
    spans = v.articles.groupBy("source").agg(F.min("published").alias("first_day"))
    listed = months.month_partitions(spans, F.col("first_day"), asof).drop("first_day")
    counts = (
        v.articles.where(F.col("published") <= asof)
        .groupBy("source", F.trunc("published", "MM").alias("month_start"))
        .agg(F.count("*").alias("articles"))
    )
    return listed.join(counts, ["source", "month_start"], "left").fillna(0, ["articles"])
