"""Registered queries over the film catalogue."""

from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, text
from gapspark.operators import catalog
from gapspark.plans.fixtures import ASOF
from gapspark.plans.registry import query
from gapspark.session import fresh_path
from gapspark.sources import tables

FILMS = ("gx_films",)


@query("gap_label", FILMS, "SELECT film_link, gap, gap_label FROM gx_films")
def _gap_label(v):
    return v.gap_films.select("film_link", "gap", "gap_label")


BOARD = """
WITH rated AS (
  SELECT film_link, movie_title, genres, critic_score, audience_score, gap, gap_label FROM gx_films
  WHERE gap IS NOT NULL),
board AS (
  SELECT * FROM (SELECT 'critic_favoured' AS side, *,
      CAST(row_number() OVER (ORDER BY gap DESC, film_link) AS INT) AS place FROM rated)
  WHERE place <= 10
  UNION ALL
  SELECT * FROM (SELECT 'audience_favoured' AS side, *,
      CAST(row_number() OVER (ORDER BY gap, film_link) AS INT) AS place FROM rated)
  WHERE place <= 10)
"""


def board(v):
    return catalog.leaderboard(
        v.gap_films.select(
            "film_link", "movie_title", "genres", "critic_score", "audience_score", "gap",
            "gap_label",
        )
    )


@query("leaderboard", FILMS, BOARD + "SELECT * FROM board")
def _leaderboard(v):
    return board(v)


@query(
    "leaderboard_bars",
    FILMS,
    BOARD
    + """SELECT side, place, film_link, gap,
      CAST(floor(abs(gap) / (SELECT CASE WHEN max(abs(gap)) = 0 THEN 1 ELSE max(abs(gap)) END
                             FROM board) * 100 + 0.5) AS INT) AS bar
    FROM board""",
)
def _leaderboard_bars(v):
    return catalog.leaderboard_bars(board(v)).select("side", "place", "film_link", "gap", "bar")


@query(
    "overview",
    FILMS,
    """SELECT count(*) AS total_films, round(avg(gap), 6) AS avg_gap,
      (SELECT movie_title FROM gx_films WHERE gap IS NOT NULL ORDER BY gap DESC, film_link LIMIT 1)
        AS most_critic_film,
      (SELECT movie_title FROM gx_films WHERE gap IS NOT NULL ORDER BY gap, film_link LIMIT 1)
        AS most_audience_film
    FROM gx_films""",
)
def _overview(v):
    return catalog.overview(v.gap_films).withColumn("avg_gap", F.round("avg_gap", 6))


GENRES = """
WITH parts AS (
  SELECT trim(g) AS genre, gap
  FROM (SELECT unnest(string_split(genres, ',')) AS g, gap FROM gx_films
        WHERE genres IS NOT NULL AND gap IS NOT NULL)),
top AS (
  SELECT genre, avg(gap) AS avg_gap, count(*) AS films FROM parts GROUP BY genre
  HAVING count(*) >= 5 ORDER BY avg_gap DESC, genre LIMIT 8)
"""


@query(
    "genre_breakdown",
    FILMS,
    GENRES + "SELECT genre, round(avg_gap, 6) AS avg_gap, films FROM top",
)
def _genre_breakdown(v):
    return catalog.genre_breakdown(v.gap_films).withColumn("avg_gap", F.round("avg_gap", 6))


@query(
    "genre_bars",
    FILMS,
    GENRES
    + """SELECT genre, round(abs(avg_gap) / (SELECT CASE WHEN max(abs(avg_gap)) = 0 THEN 1
      ELSE max(abs(avg_gap)) END FROM top), 6) AS bar_share FROM top""",
)
def _genre_bars(v):
    bars = catalog.genre_bars(catalog.genre_breakdown(v.gap_films))
    return bars.select("genre", F.round("bar_share", 6).alias("bar_share"))


CARDS = "film_link, movie_title, release_year, genres, critic_score, audience_score, gap, gap_label"


def browse_sql(order: str, where: str, page: int, per_page: int) -> str:
    return f"""WITH chosen AS (SELECT {CARDS} FROM gx_films {where})
    SELECT *, (SELECT count(*) FROM chosen) AS total, {page} AS page, {per_page} AS per_page,
      CAST(ceil((SELECT count(*) FROM chosen) / {per_page}.0) AS BIGINT) AS total_pages
    FROM chosen ORDER BY {order}, film_link LIMIT {per_page} OFFSET {(page - 1) * per_page}"""


@query("browse_divergence", FILMS, browse_sql("abs(gap) DESC NULLS LAST", "", 1, 20))
def _browse_divergence(v):
    return catalog.browse(v.gap_films)


@query(
    "browse_page",
    FILMS,
    browse_sql(
        "critic_score DESC NULLS LAST", "WHERE release_year BETWEEN 1996 AND 1999", 3, 25
    ),
)
def _browse_page(v):
    return catalog.browse(v.gap_films, 1996, 1999, "critics", page=3, per_page=25)


@query("browse_audience", FILMS, browse_sql("audience_score DESC NULLS LAST", "", 2, 100))
def _browse_audience(v):
    return catalog.browse(v.gap_films, sort_by="audience", page=2, per_page=500)


@query(
    "browse_newest",
    FILMS,
    browse_sql("release_year DESC NULLS LAST", "WHERE release_year >= 1997", 1, 20),
)
def _browse_newest(v):
    return catalog.browse(v.gap_films, from_year=1997, sort_by="newest", page=0)


@query("browse_oldest", FILMS, browse_sql("release_year NULLS LAST", "", 2, 50))
def _browse_oldest(v):
    return catalog.browse(v.gap_films, sort_by="oldest", page=2, per_page=50)


@query(
    "browse_after",
    FILMS,
    f"""SELECT {CARDS} FROM gx_films
    WHERE critic_score < 50 OR critic_score IS NULL OR (critic_score = 50 AND film_link > 'm/1')
    ORDER BY critic_score DESC NULLS LAST, film_link LIMIT 20""",
)
def _browse_after(v):
    page = catalog.browse_after(v.gap_films, "critics", 50.0, "m/1", 20)
    return page.select(*catalog.CARD_COLUMNS)


@query(
    "title_search",
    FILMS,
    """SELECT film_link, movie_title, critic_score, audience_score, gap FROM gx_films
    WHERE regexp_matches(movie_title, '(?i)R(ING|od)$') ORDER BY film_link LIMIT 10""",
)
def _title_search(v):
    return catalog.search(v.gap_films, "R(ING|od)$").select(
        "film_link", "movie_title", "critic_score", "audience_score", "gap"
    )


@query(
    "film_payload",
    FILMS,
    """SELECT film_link, movie_title, critic_score, audience_score, gap, gap_label, genres,
      strftime(release_date, '%Y-%m-%d') AS release_date, release_year FROM gx_films""",
)
def _film_payload(v):
    return catalog.payload(v.gap_films)


@query(
    "browse_badge",
    FILMS,
    """SELECT film_link,
      CASE WHEN gap > 5 THEN 'critics' WHEN gap < -5 THEN 'audience'
           WHEN gap IS NOT NULL THEN 'aligned' END AS badge,
      CASE WHEN gap >= 0 THEN '+' ELSE '' END || printf('%.1f', gap) AS badge_text,
      array_to_string(list_transform(string_split(genres, ',')[1:3], lambda g: trim(g)), '|')
        AS pills
    FROM gx_films""",
)
def _browse_badge(v):
    return catalog.badges(v.gap_films)


@query(
    "active_films",
    FILMS,
    "SELECT film_link, last_fetched_on FROM gx_films WHERE review_fetch_active = 1",
)
def _active_films(v):
    return catalog.active_films(v.gap_films).select("film_link", "last_fetched_on")


@query(
    "active_flags",
    FILMS,
    f"""SELECT film_link,
      CAST(coalesce(datediff('day', release_date, DATE '{ASOF}') <= 90, false) AS INT) AS listed,
      CAST(coalesce(datediff('day', release_date, DATE '{ASOF}') < 90, false) AS INT) AS backfilled
    FROM gx_films""",
)
def _active_flags(v):
    released = F.col("release_date")
    return v.gap_films.select(
        "film_link",
        dates.active_flag(released, ASOF, fixed.WINDOW_DAYS).alias("listed"),
        dates.active_flag(released, ASOF, fixed.WINDOW_DAYS - 1).alias("backfilled"),
    )


BACKLOG = """source IN ('backfill', 'tmdb') AND critic_score IS NULL AND imdb_id IS NOT NULL
      AND scores_fetched_on IS NULL"""


@query(
    "score_backlog",
    FILMS,
    f"""SELECT film_link, movie_title, imdb_id, release_year FROM gx_films WHERE {BACKLOG}""",
)
def _score_backlog(v):
    return catalog.score_backlog(v.gap_films)


@query(
    "backlog_size",
    FILMS,
    f"""SELECT count(*) AS waiting, CAST(ceil(count(*) / 200.0) AS BIGINT) AS days_left
    FROM gx_films WHERE {BACKLOG}""",
)
def _backlog_size(v):
    return catalog.backlog_size(v.gap_films)


@query(
    "load_stats",
    FILMS,
    f"""SELECT count(*) AS total_films,
      count(*) FILTER (source = 'kaggle') AS kaggle_films,
      count(*) FILTER (source IN ('backfill', 'tmdb')) AS new_films,
      count(*) FILTER (source IN ('backfill', 'tmdb') AND critic_score IS NOT NULL)
        AS new_films_scored,
      count(*) FILTER ({BACKLOG}) AS new_films_unscored
    FROM gx_films""",
)
def _load_stats(v):
    return catalog.load_stats(v.gap_films)


@query(
    "genre_items",
    FILMS,
    """SELECT film_link, len(string_split(genres, ',')) AS items,
      trim(string_split(genres, ',')[1]) AS first_genre FROM gx_films WHERE genres IS NOT NULL""",
)
def _genre_items(v):
    items = text.list_items(F.col("genres"))
    return v.gap_films.dropna(subset=["genres"]).select(
        "film_link",
        F.size(items).cast("bigint").alias("items"),
        F.get(items, F.lit(0)).alias("first_genre"),
    )


@query(
    "film_by_key",
    FILMS,
    "SELECT film_link, movie_title, gap FROM gx_films WHERE film_link = 'm/7'",
)
def _film_by_key(v):
    return catalog.film(v.gap_films, "m/7").select("film_link", "movie_title", "gap")


@query("film_scan", FILMS, "SELECT film_link, movie_title, release_date, gap FROM gx_films")
def _film_scan(v):
    path = fresh_path(v.spark, "films")
    tables.write_films(v.gap_films, path)
    return tables.read_films(v.spark, path).select("film_link", "movie_title", "release_date", "gap")


@query(
    "metrics_sink",
    FILMS,
    """SELECT gap_label AS model, 'all' AS split, count(*) AS samples,
      round_even(count(gap) / CAST(count(*) AS DOUBLE), 4) AS accuracy FROM gx_films GROUP BY gap_label""",
)
def _metrics_sink(v):
    share = F.bround(F.count("gap") / F.count("*").cast("double"), 4)
    metrics = v.gap_films.groupBy(F.col("gap_label").alias("model")).agg(
        F.lit("all").alias("split"), F.count("*").alias("samples"), share.alias("accuracy")
    )
    path = fresh_path(v.spark, "metrics")
    tables.write_metrics(metrics, path)
    return v.spark.read.schema("model string, split string, samples long, accuracy double").json(path)


@query(
    "empty_tables",
    FILMS,
    """SELECT 'films' AS name, NOT EXISTS (SELECT 1 FROM gx_films) AS empty
    UNION ALL SELECT 'unknown', NOT EXISTS (SELECT 1 FROM gx_films WHERE film_link IS NULL)""",
)
def _empty_tables(v):
    films = v.gap_films
    found = {"films": films, "unknown": films.where("film_link IS NULL")}
    return v.spark.createDataFrame(
        [(name, tables.is_empty(df)) for name, df in found.items()], "name string, empty boolean"
    )
