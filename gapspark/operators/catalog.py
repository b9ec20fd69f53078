"""Questions about the film catalogue: gaps, rankings, browsing, search, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import scores, text

CARD_COLUMNS = (
    "film_link", "movie_title", "release_year", "genres",
    "critic_score", "audience_score", "gap", "gap_label",
)
PAYLOAD_COLUMNS = (
    "film_link", "movie_title", "critic_score", "audience_score", "gap", "gap_label",
    "genres", "directors", "release_date", "release_year", "critics_consensus",
    "runtime", "poster_url", "audience_score_source",
)


def with_gap(films: DataFrame, digits: int | None = None) -> DataFrame:
    """Films with their gap and its label."""
    g = scores.gap(F.col("critic_score"), F.col("audience_score"), digits)
    return films.withColumn("gap", g).withColumn("gap_label", scores.gap_label(F.col("gap")))


def scored_films(films: DataFrame) -> DataFrame:
    return films.dropna(subset=["critic_score", "audience_score", "gap"])


def film(films: DataFrame, link: str) -> DataFrame:
    return films.where(F.col("film_link") == link)


def payload(films: DataFrame) -> DataFrame:
    """The display row of a film, with its date as ISO text."""
    kept = [c for c in PAYLOAD_COLUMNS if c in films.columns]
    return films.select(*kept).withColumn(
        "release_date", F.date_format("release_date", "yyyy-MM-dd")
    )


def leaderboard(films: DataFrame, n: int = 20) -> DataFrame:
    """The n // 2 films critics favoured most and the n // 2 audiences favoured most."""
    half = n // 2
    rated = scored_films(films)
    critics = rated.orderBy(F.desc("gap"), "film_link").limit(half)
    audience = rated.orderBy(F.asc("gap"), "film_link").limit(half)
    both = critics.withColumn("side", F.lit("critic_favoured")).unionByName(
        audience.withColumn("side", F.lit("audience_favoured"))
    )
    best_first = F.when(F.col("side") == "critic_favoured", -F.col("gap")).otherwise(F.col("gap"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(best_first, "film_link"))
    return both.withColumn("place", place)


def leaderboard_bars(board: DataFrame) -> DataFrame:
    """Bar length of every leaderboard row against the widest of both lists.

    The board is a top list of fixed length, so one window over it is small.
    """
    widest = F.max(F.abs("gap")).over(Window.partitionBy(F.lit(1)))
    return board.withColumn("bar", scores.bar_width(F.col("gap"), widest))


def overview(films: DataFrame) -> DataFrame:
    """Film count, mean gap and the titles at both ends, in one aggregation."""
    rated = F.col("gap").isNotNull()
    highest = F.when(rated, F.struct(-F.col("gap"), F.col("film_link")))
    lowest = F.when(rated, F.struct(F.col("gap"), F.col("film_link")))
    return films.agg(
        F.count("*").alias("total_films"),
        F.avg("gap").alias("avg_gap"),
        F.min_by("movie_title", highest).alias("most_critic_film"),
        F.min_by("movie_title", lowest).alias("most_audience_film"),
    )


def genre_breakdown(films: DataFrame, min_films: int = 5, top: int = 8) -> DataFrame:
    """Mean gap of the genres with enough films, the highest first."""
    return (
        films.dropna(subset=["genres", "gap"])
        .select(F.explode(text.list_items(F.col("genres"))).alias("genre"), "gap")
        .groupBy("genre")
        .agg(F.avg("gap").alias("avg_gap"), F.count("*").alias("films"))
        .where(F.col("films") >= min_films)
        .orderBy(F.desc("avg_gap"), "genre")
        .limit(top)
    )


def genre_bars(breakdown: DataFrame) -> DataFrame:
    """Bar share of every genre against the widest; the breakdown is a top list."""
    widest = F.max(F.abs("avg_gap")).over(Window.partitionBy(F.lit(1)))
    scale = F.when(widest == 0, F.lit(1.0)).otherwise(widest)
    return breakdown.withColumn("bar_share", F.abs("avg_gap") / scale)


def search(films: DataFrame, query: str, limit: int = 10, literal: bool = False) -> DataFrame:
    """Films whose title contains a pattern, in any letter case; first by key."""
    if not query:
        return films.limit(0)
    title = F.col("movie_title")
    hit = F.lower(title).contains(query.lower()) if literal else title.rlike("(?i)" + query)
    return films.where(hit).orderBy("film_link").limit(limit)


def in_years(films: DataFrame, from_year: int | None = None, to_year: int | None = None):
    """Films of an inclusive range of years; without bounds also those without a year."""
    if from_year is not None:
        films = films.where(F.col("release_year") >= from_year)
    if to_year is not None:
        films = films.where(F.col("release_year") <= to_year)
    return films


def browse_order(sort_by: str) -> list[Column]:
    """Sort keys of a browse list: missing values last, the film key breaks ties."""
    leading = {
        "divergence": F.desc_nulls_last(F.abs("gap")),
        "critics": F.desc_nulls_last("critic_score"),
        "audience": F.desc_nulls_last("audience_score"),
        "newest": F.desc_nulls_last("release_year"),
        "oldest": F.asc_nulls_last("release_year"),
    }.get(sort_by)
    return ([leading] if leading is not None else []) + [F.asc("film_link")]


def browse(
    films: DataFrame,
    from_year: int | None = None,
    to_year: int | None = None,
    sort_by: str = "divergence",
    page: int = 1,
    per_page: int = 20,
) -> DataFrame:
    """One page of the browse list with the totals of the whole list.

    Spark keeps only offset + limit rows per partition for this plan; for pages
    far down the list use ``browse_after``.
    """
    per_page = max(1, min(per_page, 100))
    page = max(1, page)
    chosen = in_years(films, from_year, to_year)
    cards = [c for c in CARD_COLUMNS if c in films.columns]
    total = chosen.agg(F.count("*"))
    shown = (
        chosen.select(*cards)
        .orderBy(*browse_order(sort_by))
        .offset((page - 1) * per_page)
        .limit(per_page)
    )
    return shown.select(
        "*",
        total.scalar().alias("total"),
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(total.scalar() / per_page).alias("total_pages"),
    )


def browse_after(
    films: DataFrame, sort_by: str, last_value, last_key: str, per_page: int = 20
) -> DataFrame:
    """The page that follows a given row (its sort value and key), at any depth.

    A filter replaces the offset, so page one million costs as much as page two.
    """
    per_page = max(1, min(per_page, 100))
    value = {
        "divergence": F.abs("gap"),
        "critics": F.col("critic_score"),
        "audience": F.col("audience_score"),
        "newest": F.col("release_year"),
        "oldest": F.col("release_year"),
    }.get(sort_by)
    later_key = F.col("film_link") > last_key
    if value is None:
        beyond = later_key
    elif last_value is None:
        beyond = value.isNull() & later_key
    else:
        past = value > last_value if sort_by == "oldest" else value < last_value
        beyond = past | value.isNull() | ((value == last_value) & later_key)
    return films.where(beyond).orderBy(*browse_order(sort_by)).limit(per_page)


def badges(films: DataFrame) -> DataFrame:
    """Browse cards: side of the gap, its signed text and the first three genres."""
    g = F.col("gap")
    signed = F.concat(F.when(g >= 0, "+").otherwise(""), F.format_string("%.1f", g))
    return films.select(
        "film_link",
        scores.gap_badge(g).alias("badge"),
        F.when(g.isNotNull(), signed).alias("badge_text"),
        F.array_join(F.slice(text.list_items(F.col("genres")), 1, 3), "|").alias("pills"),
    )


def active_films(films: DataFrame) -> DataFrame:
    """Films whose review window is open, those not fetched for longest first."""
    return films.where("review_fetch_active = 1").orderBy(
        F.asc_nulls_first("last_fetched_on"), "film_link"
    )


def in_backlog() -> Column:
    """Films found by us that have an id but were never asked for scores."""
    return (
        F.col("source").isin(*fixed.BACKLOG_SOURCES)
        & F.col("critic_score").isNull()
        & F.col("imdb_id").isNotNull()
        & F.col("scores_fetched_on").isNull()
    )


def score_backlog(films: DataFrame, limit: int | None = None) -> DataFrame:
    """The backlog, or the newest ``limit`` films of it where answers are rationed."""
    waiting = films.where(in_backlog()).select(
        "film_link", "movie_title", "imdb_id", "release_year"
    )
    if limit is None:
        return waiting
    return waiting.orderBy(F.desc_nulls_last("release_year"), "film_link").limit(limit)


def backlog_size(films: DataFrame, per_day: int = fixed.BACKLOG_LIMIT) -> DataFrame:
    """Backlog length and the days it takes at a daily quota."""
    waiting = F.count_if(in_backlog())
    return films.agg(
        waiting.alias("waiting"), F.ceil(waiting / per_day).cast("bigint").alias("days_left")
    )


def load_stats(films: DataFrame) -> DataFrame:
    """Film counts by origin and scored state, in one pass."""
    own = F.col("source").isin(*fixed.BACKLOG_SOURCES)
    return films.agg(
        F.count("*").alias("total_films"),
        F.count_if(F.col("source") == "kaggle").alias("kaggle_films"),
        F.count_if(own).alias("new_films"),
        F.count_if(own & F.col("critic_score").isNotNull()).alias("new_films_scored"),
        F.count_if(in_backlog()).alias("new_films_unscored"),
    )
