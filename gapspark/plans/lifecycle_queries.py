"""Registered queries over review windows and the daily batch."""

from pyspark.sql import functions as F

from gapspark.operators import lifecycle, link
from gapspark.plans.fixtures import ASOF
from gapspark.plans.ingest_queries import LINKED, detail_docs, review_rows
from gapspark.plans.merge_queries import PAYLOADS, answers
from gapspark.plans.registry import query
from gapspark.sources import documents

REASON = f"""CASE WHEN review_fetch_active = 1 THEN CASE
    WHEN release_date IS NOT NULL AND reviews_updated_on IS NULL THEN
      CASE WHEN datediff('day', release_date, DATE '{ASOF}') > 90
        THEN 'past 90-day window with no API reviews' END
    WHEN datediff('day', reviews_updated_on, DATE '{ASOF}') > 14
      THEN 'no new reviews for 14+ consecutive days'
    WHEN reviews_updated_on IS NULL AND datediff('day', last_fetched_on, DATE '{ASOF}') > 14
      THEN 'checked daily for 14+ days without finding reviews' END END"""


@query(
    "window_close",
    ("gx_films",),
    f"""SELECT film_link, reason FROM (SELECT film_link, {REASON} AS reason FROM gx_films)
    WHERE reason IS NOT NULL""",
)
def _window_close(v):
    return lifecycle.closing_films(v.gap_films, ASOF).select("film_link", "reason")


@query(
    "window_reopen",
    ("fx_articles", "gx_films"),
    LINKED
    + f"""SELECT film_link, 1 AS review_fetch_active, DATE '{ASOF}' AS reviews_updated_on,
      CAST(NULL AS DATE) AS last_fetched_on
    FROM gx_films WHERE review_fetch_active = 0
      AND film_link IN (SELECT film_link FROM linked WHERE body <> '' AND film_link IS NOT NULL)""",
)
def _window_reopen(v):
    linked = link.linked_reviews(review_rows(v).where("has_body"), v.gap_films)
    return lifecycle.reopen(v.gap_films, linked, ASOF).select(
        "film_link", "review_fetch_active", "reviews_updated_on", "last_fetched_on"
    )


def tracked(v):
    """The film table as the batch jobs keep it."""
    return v.gap_films.select(
        "film_link", "movie_title", "imdb_id", "release_date", "release_year", "critic_score",
        "audience_score", F.lit(None).cast("string").alias("audience_score_source"), "gap",
        "gap_label", "source", "review_fetch_active", "last_fetched_on", "reviews_updated_on",
        "scores_fetched_on",
    )


TRACKED = """films0 AS (SELECT film_link, movie_title, imdb_id, release_date, release_year,
    critic_score, audience_score, CAST(NULL AS STRING) AS audience_score_source, gap, gap_label,
    source, review_fetch_active, last_fetched_on, reviews_updated_on, scores_fetched_on
  FROM gx_films)"""


def label_sql(gap: str) -> str:
    return f"""CASE WHEN {gap} > 20 THEN 'Critics loved it, audiences didn''t'
      WHEN {gap} < -20 THEN 'Audiences loved it, critics didn''t' ELSE 'Aligned' END"""


def backlog_sql(films: str, out: str) -> str:
    """Backlog scoring of table ``films`` as SQL, giving table ``out``."""
    return f"""{out}_asked AS (SELECT film_link, imdb_id FROM {films}
    WHERE source IN ('backfill', 'tmdb') AND critic_score IS NULL AND imdb_id IS NOT NULL
      AND scores_fetched_on IS NULL),
  {out}_got AS (SELECT q.film_link, a.critic_score AS c, a.audience_proxy AS p,
      round_even(a.critic_score - a.audience_proxy, 2) AS g,
      a.critic_score IS NOT NULL OR a.audience_proxy IS NOT NULL AS usable
    FROM {out}_asked q LEFT JOIN answers a ON q.imdb_id = a.imdb_id),
  {out} AS (SELECT f.* REPLACE (
      CASE WHEN usable THEN c ELSE critic_score END AS critic_score,
      CASE WHEN usable THEN p ELSE audience_score END AS audience_score,
      CASE WHEN usable THEN CASE WHEN p IS NOT NULL THEN 'imdb' END ELSE audience_score_source END
        AS audience_score_source,
      CASE WHEN usable THEN g ELSE gap END AS gap,
      CASE WHEN usable THEN {label_sql('g')} ELSE gap_label END AS gap_label,
      CASE WHEN n.film_link IS NOT NULL THEN DATE '{ASOF}' ELSE scores_fetched_on END
        AS scores_fetched_on)
    FROM {films} f LEFT JOIN {out}_got n ON f.film_link = n.film_link)"""


def refresh_sql(films: str, out: str) -> str:
    """Refresh of open films' scores in table ``films`` as SQL, giving table ``out``."""
    return f"""{out}_hit AS (SELECT f.*, a.critic_score AS c,
      CASE WHEN f.audience_score IS NULL THEN a.audience_proxy END AS fill
    FROM {films} f JOIN answers a ON f.imdb_id = a.imdb_id
    WHERE review_fetch_active = 1 AND a.critic_score IS NOT NULL),
  {out}_new AS (SELECT * EXCLUDE (c, fill) REPLACE (
      c AS critic_score, coalesce(audience_score, fill) AS audience_score,
      CASE WHEN fill IS NOT NULL THEN 'imdb' ELSE audience_score_source END
        AS audience_score_source,
      coalesce(round_even(c - coalesce(audience_score, fill), 2), gap) AS gap,
      {label_sql('coalesce(round_even(c - coalesce(audience_score, fill), 2), gap)')} AS gap_label,
      DATE '{ASOF}' AS scores_fetched_on) FROM {out}_hit),
  {out} AS (SELECT * FROM {out}_new
    UNION ALL BY NAME SELECT * FROM {films}
    WHERE film_link NOT IN (SELECT film_link FROM {out}_hit))"""


SHOWN = """SELECT film_link, critic_score, round(audience_score, 6) AS audience_score,
  audience_score_source, round(gap, 6) AS gap, gap_label, scores_fetched_on"""


def shown(films):
    return films.select(
        "film_link",
        "critic_score",
        F.round("audience_score", 6).alias("audience_score"),
        "audience_score_source",
        F.round("gap", 6).alias("gap"),
        "gap_label",
        "scores_fetched_on",
    )


@query(
    "backlog_scoring",
    ("gx_films", "fx_scores"),
    PAYLOADS + f", {TRACKED}, {backlog_sql('films0', 'scored')} {SHOWN} FROM scored",
)
def _backlog_scoring(v):
    return shown(lifecycle.score_backlog_run(tracked(v), answers(v), ASOF))


@query(
    "score_refresh",
    ("gx_films", "fx_scores"),
    PAYLOADS + f", {TRACKED}, {refresh_sql('films0', 'fresh')} {SHOWN} FROM fresh",
)
def _score_refresh(v):
    return shown(lifecycle.refresh_active_scores(tracked(v), answers(v), ASOF))


# The whole batch: every third film is not stored yet and comes in as a discovery.
DAILY = (
    PAYLOADS
    + f""", {TRACKED},
known AS (SELECT * FROM films0 WHERE source <> 'tmdb'),
found AS (SELECT 'tmdb/' || CAST(film_id AS STRING) AS film_link, movie_title, f.imdb_id,
    release_date, release_year, a.critic_score, a.audience_proxy AS audience_score,
    CASE WHEN a.audience_proxy IS NOT NULL THEN 'imdb' END AS audience_score_source,
    round_even(a.critic_score - a.audience_proxy, 2) AS gap,
    {label_sql('round_even(a.critic_score - a.audience_proxy, 2)')} AS gap_label,
    'tmdb' AS source, 1 AS review_fetch_active, CAST(NULL AS DATE) AS last_fetched_on,
    CAST(NULL AS DATE) AS reviews_updated_on,
    CASE WHEN a.imdb_id IS NOT NULL THEN DATE '{ASOF}' END AS scores_fetched_on
  FROM gx_films f LEFT JOIN answers a ON f.imdb_id = a.imdb_id WHERE source = 'tmdb'),
films1 AS (SELECT * FROM known UNION ALL BY NAME SELECT * FROM found),
{backlog_sql('films1', 'films2')},
{refresh_sql('films2', 'films3')},
"""
    + LINKED.removeprefix("WITH").replace("FROM gx_films\n", "FROM films3\n")
    + f""",
good AS (SELECT * FROM linked WHERE body <> '' AND film_link IS NOT NULL),
fresh_articles AS (SELECT DISTINCT film_link FROM good WHERE published >= DATE '1998-01-01'),
hit AS (SELECT DISTINCT film_link FROM good),
films4 AS (SELECT f.* REPLACE (
    CASE WHEN h.film_link IS NOT NULL
        AND (n.film_link IS NOT NULL OR coalesce(review_fetch_active, 0) = 0)
      THEN DATE '{ASOF}' ELSE reviews_updated_on END AS reviews_updated_on,
    CASE WHEN h.film_link IS NOT NULL THEN DATE '{ASOF}' ELSE last_fetched_on END
      AS last_fetched_on,
    CASE WHEN h.film_link IS NOT NULL THEN 1 ELSE review_fetch_active END AS review_fetch_active)
  FROM films3 f LEFT JOIN hit h ON f.film_link = h.film_link
  LEFT JOIN fresh_articles n ON f.film_link = n.film_link)
"""
)


def daily(v):
    known = tracked(v).where("source <> 'tmdb'")
    found = (
        documents.film_rows(detail_docs(v), ASOF)
        .join(
            v.gap_films.where("source = 'tmdb'").select(
                F.concat(F.lit("tmdb/"), F.col("film_id").cast("string")).alias("film_link")
            ),
            "film_link",
            "left_semi",
        )
    )
    columns = known.columns
    articles = review_rows(v).where("has_body").drop("has_body")
    brought = found.select(*(c for c in found.columns if c in columns), "tmdb_id")
    titles = known.select("film_link", "movie_title").unionByName(
        brought.select("film_link", "movie_title")
    )
    stored = link.linked_reviews(articles.where("review_date < '1998-01-01'"), titles)
    return lifecycle.daily_update(known, stored, brought, answers(v), articles, ASOF)


@query(
    "daily_update",
    ("gx_films", "fx_scores", "fx_articles"),
    DAILY
    + f"""SELECT film_link, critic_score, round(audience_score, 6) AS audience_score,
      round(gap, 6) AS gap, gap_label, scores_fetched_on, reviews_updated_on, last_fetched_on,
      CASE WHEN {REASON} IS NOT NULL THEN 0 ELSE review_fetch_active END AS review_fetch_active
    FROM films4""",
)
def _daily_update(v):
    return daily(v).films.select(
        "film_link",
        "critic_score",
        F.round("audience_score", 6).alias("audience_score"),
        F.round("gap", 6).alias("gap"),
        "gap_label",
        "scores_fetched_on",
        "reviews_updated_on",
        "last_fetched_on",
        "review_fetch_active",
    )


@query(
    "daily_new_reviews",
    ("gx_films", "fx_scores", "fx_articles"),
    DAILY
    + """SELECT film_link, source, CAST(article_id AS STRING) AS external_id, published
      AS review_date, byline AS critic_name FROM good WHERE published >= DATE '1998-01-01'""",
)
def _daily_new_reviews(v):
    return daily(v).new_reviews.select(
        "film_link", "source", "external_id", "review_date", "critic_name"
    )
