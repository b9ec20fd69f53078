"""JSON documents from a landing folder: films found, film details, scores, articles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark import fixed, schemas
from gapspark.functions import dates, scores, text


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema: no inference pass over the data."""
    return spark.read.schema(schema).json(path)


def film_key(doc_id: Column) -> Column:
    return F.concat(F.lit("tmdb/"), doc_id.cast("string"))


def discovered_films(
    docs: DataFrame,
    from_day,
    to_day,
    min_votes: int = fixed.DAILY_MIN_VOTES,
    min_popularity: float | None = fixed.DAILY_MIN_POPULARITY,
) -> DataFrame:
    """English films released in a range of days that enough people voted on.

    The defaults are the daily rule; a backfill passes more votes and no
    popularity bound.
    """
    released = dates.parse_day(F.col("release_date"))
    keep = (
        released.between(dates.day(from_day), dates.day(to_day))
        & (F.col("original_language") == "en")
        & (F.col("vote_count") >= min_votes)
    )
    if min_popularity is not None:
        keep = keep & (F.col("popularity") >= min_popularity)
    return docs.where(keep).select(
        film_key(F.col("id")).alias("film_link"),
        F.col("id").alias("tmdb_id"),
        F.col("title").alias("listed_title"),
        released.alias("release_date"),
        "popularity",
        "vote_count",
    )


def directors(crew: Column, most: int | None = None) -> Column:
    """Directors of a film joined by commas, the first ``most`` of them."""
    names = F.transform(F.filter(crew, lambda c: c["job"] == "Director"), lambda c: c["name"])
    if most is not None:
        names = F.slice(names, 1, most)
    return text.empty_to_null(F.array_join(names, ", "))


def genre_ids(genres: Column, ids: Column) -> Column:
    """The id list of a document, or the ids of its genre objects when it has none."""
    return F.when(F.size(ids) > 0, ids).otherwise(F.transform(genres, lambda g: g["id"]))


#: Genres a map may hold: it becomes a literal of the plan.
MOST_GENRES = 1000


def genre_names(ids: Column, genre_map: DataFrame) -> Column:
    """Names of a list of genre ids, in order; unknown ids are kept as text.

    ``genre_map`` has the columns id and name; it holds some twenty rows and is looked
    up inside the row.
    """
    found = genre_map.where("id IS NOT NULL").limit(MOST_GENRES + 1).collect()
    if len(found) > MOST_GENRES:
        raise ValueError("a genre map of more than a thousand rows is no genre map")
    known = F.create_map(*(F.lit(x) for r in found for x in (int(r["id"]), r["name"]))) if found else None

    def name(i: Column) -> Column:
        text_of_id = i.cast("string")
        if known is None:
            return text_of_id
        return F.coalesce(F.try_element_at(known, i.cast("int")), text_of_id)

    return F.array_join(F.transform(ids, name), ", ")


def film_rows(
    details: DataFrame,
    asof,
    source: str = "tmdb",
    genre_map: DataFrame | None = None,
    most_directors: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Film rows from detail documents.

    Daily films (``source`` "tmdb") start with an open window; backfill films only
    when released less than 90 days before ``asof``.
    """
    released = dates.parse_day(F.col("release_date"))
    daily = source == "tmdb"
    year = F.year(released)
    if daily:
        year = F.coalesce(year, F.left("release_date", F.lit(4)).try_cast("int"))
    rows = details.select(
        film_key(F.col("id")).alias("film_link"),
        F.col("title").alias("movie_title"),
        text.empty_to_null(
            F.array_join(F.transform("genres", lambda g: g["name"]), ", ")
        ).alias("genres"),
        genre_ids(F.col("genres"), F.col("genre_ids")).alias("_ids"),
        directors(F.col("credits.crew"), most_directors).alias("directors"),
        F.col("runtime").cast("double").alias("runtime"),
        released.alias("release_date"),
        year.alias("release_year"),
        text.empty_to_null(
            text.clip_chars(F.col("overview"), max_chars)
        ).alias("critics_consensus"),
        F.col("id").alias("tmdb_id"),
        "imdb_id",
        F.concat(
            F.lit(fixed.POSTER_PREFIX), text.empty_to_null(F.col("poster_path"))
        ).alias("poster_url"),
        F.lit(source).alias("source"),
        (
            F.lit(1) if daily else dates.active_flag(released, asof, fixed.WINDOW_DAYS - 1)
        ).alias("review_fetch_active"),
    )
    if genre_map is not None:
        named = F.when(F.size("_ids") > 0, genre_names(F.col("_ids"), genre_map))
        rows = rows.withColumn("genres", named)
    return rows.drop("_ids")


def parse_scores(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """Scores of every payload that answers; failed answers are dropped.

    Adds critic_score and audience_proxy, either of which may be NULL.
    """
    doc = F.from_json(payload, schemas.SCORE_DOC)
    return (
        docs.withColumn("_doc", doc)
        .where(F.col("_doc.Response") == "True")
        .select(
            *(c for c in docs.columns if c != payload),
            scores.critic_percent(F.col("_doc.Ratings")).alias("critic_score"),
            scores.audience_proxy(F.col("_doc.imdbRating")).alias("audience_proxy"),
        )
    )


@dataclass(frozen=True)
class Outlet:
    """What a review source writes into its rows."""

    source: str
    publisher: str
    default_critic: str


OUTLET_A = Outlet("guardian", "The Guardian", "The Guardian")
OUTLET_B = Outlet("nyt", "New York Times", "NYT")


def articles_with_stars(
    docs: DataFrame, outlet: Outlet = OUTLET_A, max_chars: int | None = None
) -> DataFrame:
    """Review rows from articles that may carry a star rating; ``max_chars`` cuts bodies."""
    stars = F.col("fields.starRating")
    content = text.strip(F.coalesce(F.col("fields.bodyText"), F.lit("")))
    critic = F.coalesce(text.empty_to_null(F.col("fields.byline")), F.lit(outlet.default_critic))
    return _review_rows(
        docs,
        outlet,
        headline=F.coalesce(F.col("fields.headline"), F.lit("")),
        critic=text.strip(critic),
        day=F.col("webPublicationDate"),
        content=text.clip_chars(content, max_chars),
        review_type=scores.stars_to_type(stars),
        score=text.empty_to_null(stars),
        external_id=F.col("id"),
    )


def articles_plain(
    docs: DataFrame, outlet: Outlet = OUTLET_B, max_chars: int | None = None
) -> DataFrame:
    """Review rows from articles without ratings: abstract, else lead paragraph."""
    content = F.coalesce(
        text.empty_to_null(F.col("abstract")), F.col("lead_paragraph"), F.lit("")
    )
    return _review_rows(
        docs,
        outlet,
        headline=F.coalesce(F.col("headline.main"), F.lit("")),
        critic=text.byline_name(F.col("byline.original"), outlet.default_critic),
        day=F.col("pub_date"),
        content=text.clip_chars(text.strip(content), max_chars),
        review_type=F.lit("Fresh"),
        score=F.lit(None).cast("string"),
        external_id=F.col("_id"),
    )


def _review_rows(
    docs, outlet, *, headline, critic, day, content, review_type, score, external_id
) -> DataFrame:
    return docs.where(content != "").select(
        text.headline_title(headline).alias("film_title"),
        critic.alias("critic_name"),
        F.lit(outlet.publisher).alias("publisher_name"),
        dates.parse_day(day).alias("review_date"),
        content.alias("review_content"),
        review_type.alias("review_type"),
        score.alias("review_score"),
        F.coalesce(external_id, F.lit("")).alias("external_id"),
        F.lit(outlet.source).alias("source"),
    )
