"""Registered queries over the inputs: film and review lists, documents, articles.

The raw shape (all text, or JSON) is made from the given tables, so that each
query runs the same cleaning a file would go through.
"""

from contextlib import suppress

from pyspark.sql import functions as F

from gapspark import schemas
from gapspark.functions import text
from gapspark.operators import link
from gapspark.plans.fixtures import ASOF
from gapspark.plans.merge_queries import PAYLOADS, answers
from gapspark.plans.registry import query
from gapspark.session import fresh_path
from gapspark.sources import csv_files, csv_ranges, documents
from gapspark.sources.run_log import RunLog


def as_csv(v, raw):
    """The rows as CSV files in a new folder below the shared one."""
    path = fresh_path(v.spark, "raw-csv")
    writer = raw.write.option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def through_csv(v, raw, multiline=False):
    """The rows as CSV files, read again as the readers do."""
    return csv_files.read_csv(v.spark, as_csv(v, raw), multiline)


def through_json(v, docs, schema):
    """A column of JSON texts as files of lines, read again under a schema."""
    path = fresh_path(v.spark, "raw-json")
    docs.write.text(path)
    return documents.read_json(v.spark, path, schema)


@query(
    "film_csv_ingest",
    ("gx_films",),
    f"""SELECT film_link, movie_title, genres, TRY_CAST(CASE WHEN film_id % 10 = 9 THEN 'unknown'
        ELSE CAST(film_id % 90 + 60 AS STRING) END AS DOUBLE) AS runtime,
      release_date, release_year, critic_score, audience_score, gap, gap_label,
      'kaggle' AS source,
      CAST(coalesce(datediff('day', release_date, DATE '{ASOF}') <= 2000, false) AS INT)
        AS review_fetch_active
    FROM gx_films WHERE imdb_id IS NOT NULL""",
)
def _film_csv_ingest(v):
    key = F.col("film_id")
    raw = v.gap_films.select(
        F.when(F.col("imdb_id").isNotNull(), F.concat(F.lit(" "), "film_link")).alias(
            "rotten_tomatoes_link"
        ),
        F.concat("movie_title", F.lit("\t ")).alias("movie_title"),
        F.coalesce("genres", F.lit("  ")).alias("genres"),
        F.lit("").alias("directors"),
        F.lit(None).cast("string").alias("critics_consensus"),
        F.when(key % 10 == 9, "unknown")
        .otherwise((key % 90 + 60).cast("string"))
        .alias("runtime"),
        F.coalesce(F.col("release_date").cast("string"), F.lit("soon")).alias(
            "original_release_date"
        ),
        F.coalesce(F.col("critic_score").cast("string"), F.lit("n/a")).alias("tomatometer_rating"),
        F.col("audience_score").cast("string").alias("audience_rating"),
    )
    return csv_files.clean_films(through_csv(v, raw), ASOF, window_days=2000).drop(
        "directors", "critics_consensus"
    )


@query(
    "review_csv_ingest",
    ("fx_reviews",),
    """SELECT film_link, critic_name, publisher_name,
      CASE WHEN review_type <> 'n/a' THEN review_date END AS review_date,
      review_type, review_content, 'kaggle' AS source,
      left(sha1(film_link || '|' || critic_name || '|' ||
        CASE WHEN review_type <> 'n/a' THEN CAST(review_date AS STRING) ELSE 'someday' END || '|' ||
        coalesce(review_content, '')), 20) AS external_id
    FROM fx_reviews""",
)
def _review_csv_ingest(v):
    day = F.col("review_date").cast("string")
    raw = v.reviews.select(
        F.concat("film_link", F.lit(" ")).alias("rotten_tomatoes_link"),
        "critic_name",
        "publisher_name",
        F.when(F.col("review_type") != "n/a", day).otherwise("someday").alias("review_date"),
        "review_type",
        F.lit("").alias("review_score"),
        "review_content",
    )
    return csv_files.clean_reviews(through_csv(v, raw)).drop("review_score")


LABELLED_CORPUS = """SELECT doc_id, length(text) AS chars,
      CASE WHEN quality = 1 THEN 1.0E0 ELSE 0.0E0 END AS label
    FROM documents JOIN labels USING (doc_id)"""


def rated_raw(v):
    rated = v.table("documents").join(v.table("labels"), "doc_id")
    mood = F.when(F.col("quality") == 1, " Positive").otherwise("negative ")
    return rated.select("doc_id", F.col("text").alias("review"), mood.alias("sentiment"))


def corpus_lengths(raw):
    return csv_files.clean_corpus(raw).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("chars"), "label"
    )


@query("labelled_corpus", (), LABELLED_CORPUS)
def _labelled_corpus(v):
    return corpus_lengths(through_csv(v, rated_raw(v), multiline=True))


@query("labelled_corpus_ranges", (), LABELLED_CORPUS)
def _labelled_corpus_ranges(v):
    return corpus_lengths(csv_ranges.read_csv_ranges(v.spark, as_csv(v, rated_raw(v))))


def discovery_docs(v):
    """Discovery documents over parts: votes, popularity and dates vary."""
    key = F.col("film_id")
    doc = F.to_json(
        F.struct(
            key.alias("id"),
            F.col("movie_title").alias("title"),
            (key % 12 + 0.5).alias("popularity"),
            (key % 240).alias("vote_count"),
            F.when(key % 8 == 0, "fr").otherwise("en").alias("original_language"),
            F.col("release_date").cast("string").alias("release_date"),
        )
    )
    return through_json(v, v.gap_films.select(doc.alias("value")), schemas.DISCOVERY_DOC)


@query(
    "discovered_films",
    ("gx_films",),
    """SELECT 'tmdb/' || CAST(film_id AS STRING) AS film_link, release_date, 'daily' AS rule
    FROM gx_films WHERE release_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
      AND film_id % 8 <> 0 AND film_id % 240 >= 3 AND film_id % 12 + 0.5 >= 5
    UNION ALL
    SELECT 'tmdb/' || CAST(film_id AS STRING), release_date, 'backfill'
    FROM gx_films WHERE release_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
      AND film_id % 8 <> 0 AND film_id % 240 >= 100""",
)
def _discovered_films(v):
    docs = discovery_docs(v)
    span = ("1996-01-01", "1999-12-31")
    daily = documents.discovered_films(docs, *span)
    backfill = documents.discovered_films(docs, *span, min_votes=100, min_popularity=None)
    columns = ("film_link", "release_date")
    return (
        daily.select(*columns, F.lit("daily").alias("rule"))
        .unionByName(backfill.select(*columns, F.lit("backfill").alias("rule")))
    )


def detail_docs(v):
    """Detail documents over films: genres come from nations, crew from their number."""
    key = F.col("film_id")

    def person(role: str, rest: int):
        return F.struct(
            F.concat(F.lit(f"{role} "), (key % rest).cast("string")).alias("name"),
            F.lit(role).alias("job"),
        )

    crew = F.array(person("Director", 30), person("Writer", 20), person("Director", 7))
    genres = F.array(
        F.struct((key % 30).cast("int").alias("id"), F.lit("Drama").alias("name")),
        F.struct((key % 11).cast("int").alias("id"), F.lit("War").alias("name")),
    )
    doc = F.to_json(
        F.struct(
            key.alias("id"),
            "imdb_id",
            F.col("movie_title").alias("title"),
            F.col("release_date").cast("string").alias("release_date"),
            (key % 90 + 60).cast("double").alias("runtime"),
            F.repeat("movie_title", 60).alias("overview"),
            F.when(key % 5 != 0, F.concat(F.lit("/p"), key.cast("string"))).alias("poster_path"),
            genres.alias("genres"),
            F.when(key % 2 == 0, F.array((key % 30).cast("int"), (key % 7).cast("int"))).alias(
                "genre_ids"
            ),
            F.struct(crew.alias("crew")).alias("credits"),
        )
    )
    return through_json(v, v.gap_films.select(doc.alias("value")), schemas.DETAIL_DOC)


@query(
    "film_details",
    ("gx_films",),
    f"""SELECT 'tmdb/' || CAST(film_id AS STRING) AS film_link, movie_title, 'Drama, War' AS genres,
      'Director ' || CAST(film_id % 30 AS STRING) || ', Director ' || CAST(film_id % 7 AS STRING)
        AS directors,
      CAST(film_id % 90 + 60 AS DOUBLE) AS runtime, release_date, release_year,
      repeat(movie_title, 60) AS critics_consensus, film_id AS tmdb_id, imdb_id,
      CASE WHEN film_id % 5 <> 0 THEN 'https://image.tmdb.org/t/p/w500/p' || CAST(film_id AS STRING)
        END AS poster_url,
      'tmdb' AS source, 1 AS review_fetch_active
    FROM gx_films""",
)
def _film_details(v):
    return documents.film_rows(detail_docs(v), ASOF)


NATION_GENRES = """
WITH ids AS (SELECT film_id, CAST(CASE WHEN film_id % 2 = 0 THEN [film_id % 30, film_id % 7]
    ELSE [film_id % 30, film_id % 11] END AS INT[]) AS ids FROM gx_films),
names AS (SELECT film_id, i.pos AS pos, coalesce(n_name, CAST(i.gid AS STRING)) AS name
  FROM (SELECT film_id, unnest([1, 2]) AS pos, unnest(ids) AS gid FROM ids) i
  LEFT JOIN nation ON n_nationkey = i.gid)
"""


@query(
    "genre_names",
    ("gx_films",),
    NATION_GENRES
    + f"""SELECT 'tmdb/' || CAST(f.film_id AS STRING) AS film_link, g.genres,
      CAST(coalesce(datediff('day', release_date, DATE '{ASOF}') < 90, false) AS INT)
        AS review_fetch_active
    FROM gx_films f JOIN (SELECT film_id, string_agg(name, ', ' ORDER BY pos) AS genres
      FROM names GROUP BY film_id) g ON f.film_id = g.film_id""",
)
def _genre_names(v):
    genre_map = v.table("nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")
    )
    rows = documents.film_rows(detail_docs(v), ASOF, "backfill", genre_map)
    return rows.select("film_link", "genres", "review_fetch_active")


@query(
    "score_payload",
    ("fx_scores",),
    PAYLOADS + "SELECT imdb_id, critic_score, audience_proxy FROM answers",
)
def _score_payload(v):
    return answers(v)


# Headline rules as SQL; RE2 knows the same pattern.
TITLES = r"""
titles AS (
  SELECT *, CASE
    WHEN regexp_matches(headline, '^[Rr]eview\s*[:–\-]\s*[''‘’“”]?(.+?)[''‘’“”]?\s+(?:is|are|has|have|was|were|offers|takes|gives|brings)')
      THEN trim(regexp_extract(headline, '^[Rr]eview\s*[:–\-]\s*[''‘’“”]?(.+?)[''‘’“”]?\s+(?:is|are|has|have|was|were|offers|takes|gives|brings)', 1))
    WHEN strpos(lower(headline), ' review') > 3
      THEN trim(trim(left(headline, strpos(lower(headline), ' review') - 1)), '''"‘’“”')
    WHEN strpos(lower(headline), ' – ') > 3
      THEN trim(trim(left(headline, strpos(lower(headline), ' – ') - 1)), '''"‘’“”')
    WHEN strpos(lower(headline), ' - ') > 3
      THEN trim(trim(left(headline, strpos(lower(headline), ' - ') - 1)), '''"‘’“”')
    WHEN strpos(lower(headline), ': ') > 3
      THEN trim(trim(left(headline, strpos(lower(headline), ': ') - 1)), '''"‘’“”')
    ELSE trim(headline) END AS film_title
  FROM fx_articles)
"""


@query(
    "headline_titles",
    ("fx_articles",),
    "WITH" + TITLES + "SELECT article_id, headline, film_title FROM titles",
)
def _headline_titles(v):
    return v.articles.select(
        "article_id", "headline", text.headline_title(F.col("headline")).alias("film_title")
    )


def docs_with_stars(v):
    fields = F.struct(
        "headline",
        F.when(F.col("article_id") % 4 != 0, F.concat(F.col("byline"), F.lit(" "))).alias("byline"),
        F.col("body").alias("bodyText"),
        F.col("stars").alias("starRating"),
    )
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("film/"), F.col("article_id").cast("string")).alias("id"),
            F.concat(F.col("published").cast("string"), F.lit("T08:00:00Z")).alias(
                "webPublicationDate"
            ),
            fields.alias("fields"),
        )
    )
    return through_json(v, v.articles.select(doc.alias("value")), schemas.ARTICLE_DOC_A)


@query(
    "articles_with_stars",
    ("fx_articles",),
    "WITH"
    + TITLES
    + """SELECT film_title,
      CASE WHEN article_id % 4 <> 0 THEN byline ELSE 'The Guardian' END AS critic_name,
      'The Guardian' AS publisher_name, published AS review_date, body AS review_content,
      CASE WHEN stars IS NULL OR CAST(stars AS INT) >= 3 THEN 'Fresh' ELSE 'Rotten' END
        AS review_type,
      stars AS review_score, 'film/' || CAST(article_id AS STRING) AS external_id,
      'guardian' AS source
    FROM titles WHERE body <> ''""",
)
def _articles_with_stars(v):
    return documents.articles_with_stars(docs_with_stars(v))


def docs_plain(v):
    key = F.col("article_id")
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("nyt://"), key.cast("string")).alias("_id"),
            F.concat(F.col("published").cast("string"), F.lit("T08:00:00Z")).alias("pub_date"),
            F.when(key % 3 == 0, "").otherwise(F.col("body")).alias("abstract"),
            F.when(key % 9 != 0, F.concat(F.lit("Lead. "), F.col("body"))).alias("lead_paragraph"),
            F.struct(F.col("headline").alias("main")).alias("headline"),
            F.struct(
                F.when(key % 4 == 0, "by  ").when(key % 4 != 1, F.col("byline")).alias("original")
            ).alias("byline"),
        )
    )
    return through_json(v, v.articles.select(doc.alias("value")), schemas.ARTICLE_DOC_B)


@query(
    "articles_plain",
    ("fx_articles",),
    "WITH"
    + TITLES
    + """SELECT film_title,
      CASE WHEN article_id % 4 IN (0, 1) THEN 'NYT' ELSE substr(byline, 4) END AS critic_name,
      'New York Times' AS publisher_name, published AS review_date, content AS review_content,
      'Fresh' AS review_type, CAST(NULL AS STRING) AS review_score,
      'nyt://' || CAST(article_id AS STRING) AS external_id, 'nyt' AS source
    FROM (SELECT *, trim(coalesce(nullif(CASE WHEN article_id % 3 = 0 THEN '' ELSE body END, ''),
        CASE WHEN article_id % 9 <> 0 THEN 'Lead. ' || body END, '')) AS content FROM titles)
    WHERE content <> ''""",
)
def _articles_plain(v):
    return documents.articles_plain(docs_plain(v))


@query(
    "articles_of_both",
    ("fx_articles",),
    "WITH"
    + TITLES
    + """SELECT film_title, 'guardian' AS source, count(*) AS articles,
      count(*) FILTER (stars IS NOT NULL AND CAST(stars AS INT) < 3) AS rotten
    FROM titles WHERE body <> '' GROUP BY film_title
    UNION ALL
    SELECT film_title, 'nyt', count(*), 0
    FROM (SELECT *, trim(coalesce(nullif(CASE WHEN article_id % 3 = 0 THEN '' ELSE body END, ''),
        CASE WHEN article_id % 9 <> 0 THEN 'Lead. ' || body END, '')) AS content FROM titles)
    WHERE content <> '' GROUP BY film_title""",
)
def _articles_of_both(v):
    both = documents.articles_with_stars(docs_with_stars(v)).unionByName(
        documents.articles_plain(docs_plain(v))
    )
    return both.groupBy("film_title", "source").agg(
        F.count("*").alias("articles"), F.count_if(F.col("review_type") == "Rotten").alias("rotten")
    )


def review_rows(v):
    """Articles of both sources as review rows with the title in their headline."""
    return v.articles.select(
        text.headline_title(F.col("headline")).alias("film_title"),
        F.col("byline").alias("critic_name"),
        "source",
        F.col("article_id").cast("string").alias("external_id"),
        F.col("published").alias("review_date"),
        (F.col("body") != "").alias("has_body"),
    )


LINKED = (
    "WITH"
    + TITLES
    + """,
idx AS (SELECT lower(movie_title) AS k, min(film_link) AS film_link FROM gx_films
  WHERE movie_title IS NOT NULL GROUP BY 1),
linked AS (
  SELECT article_id, t.source, published, body, byline,
    coalesce(a.film_link, b.film_link) AS film_link
  FROM titles t LEFT JOIN idx a ON lower(film_title) = a.k AND film_title <> ''
  LEFT JOIN idx b ON strpos(film_title, ':') > 0
    AND lower(trim(string_split(film_title, ':')[1])) = b.k)
"""
)


@query(
    "article_link",
    ("fx_articles", "gx_films"),
    LINKED + "SELECT CAST(article_id AS STRING) AS external_id, film_link FROM linked",
)
def _article_link(v):
    return link.link_articles(review_rows(v), v.gap_films).select("external_id", "film_link")


@query(
    "link_rate",
    ("fx_articles", "gx_films"),
    LINKED
    + """SELECT source, strftime(published, '%Y-%m') AS month, count(*) AS fetched,
      count(*) FILTER (body <> '' AND film_link IS NOT NULL) AS matched,
      count(*) FILTER (body <> '' AND film_link IS NOT NULL AND published >= DATE '1998-01-01')
        AS inserted
    FROM linked GROUP BY ALL""",
)
def _link_rate(v):
    linked = link.link_articles(review_rows(v), v.gap_films)
    stored = linked.where("has_body AND film_link IS NOT NULL AND review_date < '1998-01-01'")
    return link.link_rate(linked, stored)


@query(
    "resumed_link",
    ("fx_articles", "gx_films"),
    LINKED
    + """SELECT CAST(article_id AS STRING) AS external_id, film_link, strftime(published, '%Y-%m') AS month FROM linked
    WHERE film_link IS NOT NULL""",
)
def _resumed_link(v):
    """Months up to 1995 are imported, the next run breaks, is repeated, and run once more."""
    months = F.date_format("published", "yyyy-MM").alias("month")
    titled = v.articles.select(
        F.col("article_id").cast("string").alias("external_id"), text.headline_title(F.col("headline")).alias("film_title"), months
    )
    folder = fresh_path(v.spark, "import")
    titled.write.partitionBy("month").parquet(f"{folder}/landing")
    landing = v.spark.read.schema(titled.schema).parquet(f"{folder}/landing")
    runs = RunLog(v.spark, f"{folder}/runs", "month")

    def work(rows):
        return link.link_articles(rows, v.gap_films).where("film_link IS NOT NULL").drop("film_title")

    def breaks(rows):
        work(rows).write.parquet(f"{folder}/runs/rows/run=1")
        raise ConnectionError("broke before the commit")

    runs.run(landing, work, upto="1995-12")
    with suppress(ConnectionError):
        runs.run(landing, breaks)
    runs.run(landing, work)
    runs.run(landing, work)
    return runs.rows()
