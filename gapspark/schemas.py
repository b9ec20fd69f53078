"""Table and document schemas, as DDL text."""

FILMS = (
    """
    film_link STRING NOT NULL, movie_title STRING, genres STRING, directors STRING,
    runtime DOUBLE, release_date DATE, release_year INT,
    critic_score DOUBLE, audience_score DOUBLE, audience_score_source STRING,
    gap DOUBLE, gap_label STRING, critics_consensus STRING,
    tmdb_id BIGINT, imdb_id STRING, poster_url STRING, source STRING,
    review_fetch_active INT, last_fetched_on TIMESTAMP, reviews_updated_on TIMESTAMP,
    scores_fetched_on TIMESTAMP
    """
)

REVIEWS = (
    """
    film_link STRING NOT NULL, critic_name STRING, publisher_name STRING, review_date DATE,
    review_type STRING, review_score STRING, review_content STRING,
    source STRING, external_id STRING
    """
)

SENTIMENTS = (
    """
    film_link STRING, source STRING, external_id STRING,
    fast_label STRING, fast_confidence DOUBLE, deep_label STRING, deep_confidence DOUBLE
    """
)

# Input files -----------------------------------------------------------------

FILMS_CSV_COLUMNS = (
    "rotten_tomatoes_link", "movie_title", "critics_consensus", "genres", "directors",
    "original_release_date", "tomatometer_rating", "audience_rating",
)
REVIEWS_CSV_COLUMNS = (
    "rotten_tomatoes_link", "critic_name", "publisher_name", "review_date",
    "review_type", "review_score", "review_content",
)

DISCOVERY_DOC = (
    """
    id BIGINT, title STRING, popularity DOUBLE, vote_count BIGINT,
    original_language STRING, release_date STRING
    """
)
DETAIL_DOC = (
    """
    id BIGINT, imdb_id STRING, title STRING, release_date STRING, runtime DOUBLE,
    overview STRING, poster_path STRING,
    genres ARRAY<STRUCT<id: INT, name: STRING>>, genre_ids ARRAY<INT>,
    credits STRUCT<crew: ARRAY<STRUCT<name: STRING, job: STRING>>>
    """
)
GENRE_DOC = ("genres ARRAY<STRUCT<id: INT, name: STRING>>")
SCORE_DOC = (
    """
    Response STRING, Ratings ARRAY<STRUCT<Source: STRING, Value: STRING>>, imdbRating STRING
    """
)
ARTICLE_DOC_A = (
    """
    id STRING, webPublicationDate STRING,
    fields STRUCT<headline: STRING, byline: STRING, bodyText: STRING, starRating: STRING>
    """
)
ARTICLE_DOC_B = (
    """
    _id STRING, pub_date STRING, abstract STRING, lead_paragraph STRING,
    headline STRUCT<main: STRING>, byline STRUCT<original: STRING>
    """
)
