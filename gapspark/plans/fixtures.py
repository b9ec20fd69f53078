"""Film, review, article and score views over the given tables.

Each view states with the DataFrame API what ``FIXTURE_SQL`` states as SQL text;
the text is what the checks run on the other engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.operators import catalog

ASOF = "2001-11-10"

PHRASES = (
    "The acting is superb and every role feels lived in.",
    "The cast is wooden and the lead performance is a bore.",
    "A gripping plot keeps the story moving with real wit.",
    "The plot is a tired narrative that goes nowhere at all.",
    "Brisk pacing and tight editing make two hours fly by.",
    "It is slow and dragging, and far too long by half.",
    "Assured direction shows the vision of a true auteur!",
    "Clumsy direction wastes a decent technique throughout.",
    "The cinematography is gorgeous and each shot is stunning.",
    "The camera work looks drab, flat and ugly to the eye.",
    "Sharp dialogue sparkles in every single line spoken.",
    "The dialogue is dreadful and each word lands badly.",
    "What a finish! The climax is a joy to sit through.",
    "The ending is a mess and the climax falls apart.",
    "A lovely soundtrack lifts the mood of each scene.",
    "The music is loud, dull and the audio mix is poor.",
)

FIXTURE_SQL = {
    "fx_phrases": "SELECT * FROM (VALUES\n"
    + ",\n".join(f"({i},'{p}')" for i, p in enumerate(PHRASES))
    + ") AS fx_phrases(pid, txt)",
    "fx_reviews": """
SELECT 'm/' || CAST(l_partkey AS STRING) AS film_link,
       l_partkey AS film_id,
       s_name AS critic_name,
       n_name AS publisher_name,
       CAST(l_shipdate AS DATE) AS review_date,
       CASE WHEN l_returnflag = 'R' THEN 'Rotten'
            WHEN l_returnflag = 'A' THEN 'Fresh'
            WHEN l_linenumber % 3 = 0 THEN ' fresh '
            WHEN l_linenumber % 3 = 1 THEN 'ROTTEN'
            ELSE 'n/a' END AS review_type,
       CASE WHEN l_linestatus = 'O' THEN 'src_a' ELSE 'src_b' END AS source,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS external_id,
       p1.txt || ' ' || p2.txt AS review_content,
       CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 1 ELSE 0 END AS label
FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
JOIN fx_phrases p1 ON p1.pid = (l_orderkey + l_linenumber) % 16
JOIN fx_phrases p2 ON p2.pid = (l_orderkey * 2 + l_partkey * 4 + l_linenumber) % 16
""",
    "fx_films": """
SELECT p_partkey AS film_id,
       'm/' || CAST(p_partkey AS STRING) AS film_link,
       CASE WHEN p_partkey % 97 = 96 THEN NULL ELSE p_name END AS movie_title,
       CASE WHEN p_partkey % 29 = 28 THEN NULL ELSE p_type || ', ' || p_brand END AS genres,
       CASE WHEN p_partkey % 41 = 40 THEN NULL
            ELSE DATE '1995-01-01' + CAST((p_partkey * 7) % 2500 AS INT) END AS release_date,
       CASE WHEN p_partkey % 17 = 16 THEN NULL ELSE r.fresh_pct END AS critic_score,
       CASE WHEN p_partkey % 13 = 12 THEN NULL ELSE p_size * 2.0E0 END AS audience_score,
       CASE WHEN p_partkey % 4 = 0 THEN 'tmdb' WHEN p_partkey % 4 = 1 THEN 'backfill' ELSE 'kaggle' END AS source,
       CASE WHEN p_partkey % 11 = 10 THEN NULL ELSE 'tt' || CAST(p_partkey AS STRING) END AS imdb_id,
       CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS review_fetch_active,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE DATE '2001-10-01' END AS scores_fetched_on,
       CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE r.last_review END AS reviews_updated_on,
       CASE WHEN p_partkey % 7 = 6 THEN NULL ELSE DATE '2001-11-10' - CAST(p_partkey % 30 AS INT) END AS last_fetched_on
FROM part
LEFT JOIN (SELECT film_id,
                  round(100 * avg(CASE WHEN review_type = 'Fresh' THEN 1.0E0
                                       WHEN review_type = 'Rotten' THEN 0.0E0 END)) AS fresh_pct,
                  max(review_date) AS last_review
           FROM fx_reviews GROUP BY film_id) r ON r.film_id = p_partkey
""",
    "fx_articles": """
SELECT o_orderkey AS article_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'src_a' ELSE 'src_b' END AS source,
       CASE o_orderkey % 6
            WHEN 0 THEN p_name || ' review – a quiet triumph'
            WHEN 1 THEN 'Review: ''' || p_name || ''' is a marvel'
            WHEN 2 THEN p_name || ': the return review – louder'
            WHEN 3 THEN p_name || ' - a second look'
            WHEN 4 THEN upper(p_name) || ' review'
            ELSE 'An evening of shorts' END AS headline,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS STRING) END AS stars,
       'By Critic ' || CAST(o_custkey % 50 AS STRING) AS byline,
       CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Body of article ' || CAST(o_orderkey AS STRING) END AS body,
       CAST(o_orderdate AS DATE) AS published
FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
""",
    "fx_scores": """
SELECT 'tt' || CAST(p_partkey AS STRING) AS imdb_id,
       CASE WHEN p_partkey % 9 = 0 THEN '{"Response":"False","Error":"not found"}'
            ELSE '{"Response":"True","Ratings":[{"Source":"Internet Movie Database","Value":"7.0/10"}'
              || CASE WHEN p_partkey % 6 = 0 THEN ''
                      ELSE ',{"Source":"Rotten Tomatoes","Value":"' || CAST(p_partkey * 37 % 101 AS STRING) || '%"}' END
              || '],"imdbRating":"'
              || CASE WHEN p_partkey % 10 < 3 THEN 'N/A'
                      ELSE CAST(p_partkey % 8 + 1 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) END
              || '"}' END AS payload
FROM part
""",
    # Films with their gap (no rounding) and its label.
    "gx_films": """
SELECT *, critic_score - audience_score AS gap,
       CASE WHEN critic_score - audience_score > 20 THEN 'Critics loved it, audiences didn''t'
            WHEN critic_score - audience_score < -20 THEN 'Audiences loved it, critics didn''t'
            ELSE 'Aligned' END AS gap_label,
       CAST(year(release_date) AS INT) AS release_year
FROM fx_films
""",
}

NEEDS = {
    "fx_phrases": (),
    "fx_reviews": ("fx_phrases",),
    "fx_films": ("fx_reviews",),
    "fx_articles": (),
    "fx_scores": (),
    "gx_films": ("fx_films",),
}


def with_views(views: tuple[str, ...], sql: str) -> str:
    """``sql`` behind a WITH clause that defines the named views and what they need.

    ``sql`` may itself start with WITH; its parts are appended to the clause.
    """
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS[name]:
            add(other)
        if name not in wanted:
            wanted.append(name)

    for view in views:
        add(view)
    if not wanted:
        return sql
    clause = ",\n".join(f"{v} AS ({FIXTURE_SQL[v]})" for v in wanted)
    body = sql.strip()
    if body[:4].upper() == "WITH" and body[4].isspace():
        return f"WITH {clause},\n{body[5:]}"
    return f"WITH {clause}\n{body}"


def _phrase(number: Column) -> Column:
    """A phrase by number, as a lookup in a constant array: no join."""
    texts = F.array(*(F.lit(p) for p in PHRASES))
    return F.get(texts, number.cast("int"))


class Views:
    """The views over one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def plain_reviews(self) -> DataFrame:
        """Reviews without critic and publisher, from one table over all cores."""
        lines = self.table("lineitem")
        return self._reviews_of(lines)

    def _reviews_of(self, lines: DataFrame) -> DataFrame:
        order, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        flag = F.col("l_returnflag")
        return lines.select(
            F.concat(F.lit("m/"), part.cast("string")).alias("film_link"),
            part.alias("film_id"),
            "l_suppkey",
            F.col("l_shipdate").cast("date").alias("review_date"),
            F.when(flag == "R", "Rotten")
            .when(flag == "A", "Fresh")
            .when(line % 3 == 0, " fresh ")
            .when(line % 3 == 1, "ROTTEN")
            .otherwise("n/a")
            .alias("review_type"),
            F.when(F.col("l_linestatus") == "O", "src_a").otherwise("src_b").alias("source"),
            F.concat_ws("-", order.cast("string"), line.cast("string")).alias("external_id"),
            F.concat_ws(
                " ", _phrase((order + line) % 16), _phrase((order * 2 + part * 4 + line) % 16)
            ).alias("review_content"),
            F.when((order + line) % 2 == 0, 1).otherwise(0).alias("label"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        # One small table after the other: Spark then sees the size of each.
        named = self.plain_reviews.join(
            self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        ).join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return named.select(
            "film_link",
            "film_id",
            F.col("s_name").alias("critic_name"),
            F.col("n_name").alias("publisher_name"),
            "review_date",
            "review_type",
            "source",
            "external_id",
            "review_content",
            "label",
        )

    @cached_property
    def films(self) -> DataFrame:
        fresh = F.when(F.col("review_type") == "Fresh", 1.0).when(
            F.col("review_type") == "Rotten", 0.0
        )
        rated = self._reviews_of(self.table("lineitem")).groupBy("film_id").agg(
            F.round(F.avg(fresh) * 100).alias("fresh_pct"),
            F.max("review_date").alias("last_review"),
        )
        key = F.col("p_partkey")

        def unless(modulus: int, rest: int, value: Column) -> Column:
            return F.when(key % modulus != rest, value)

        first = F.lit("1995-01-01").cast("date")
        asof = F.lit(ASOF).cast("date")
        films = self.table("part").join(rated, key == F.col("film_id"), "left")
        return films.select(
            key.alias("film_id"),
            F.concat(F.lit("m/"), key.cast("string")).alias("film_link"),
            unless(97, 96, F.col("p_name")).alias("movie_title"),
            unless(29, 28, F.concat_ws(", ", "p_type", "p_brand")).alias("genres"),
            unless(41, 40, F.date_add(first, (key * 7 % 2500).cast("int"))).alias("release_date"),
            unless(17, 16, F.col("fresh_pct")).alias("critic_score"),
            unless(13, 12, F.col("p_size") * 2.0).alias("audience_score"),
            F.when(key % 4 == 0, "tmdb").when(key % 4 == 1, "backfill").otherwise("kaggle").alias(
                "source"
            ),
            unless(11, 10, F.concat(F.lit("tt"), key.cast("string"))).alias("imdb_id"),
            F.when(key % 3 == 0, 1).otherwise(0).alias("review_fetch_active"),
            unless(2, 0, F.lit("2001-10-01").cast("date")).alias("scores_fetched_on"),
            unless(5, 4, F.col("last_review")).alias("reviews_updated_on"),
            unless(7, 6, F.date_sub(asof, (key % 30).cast("int"))).alias("last_fetched_on"),
        )

    @cached_property
    def gap_films(self) -> DataFrame:
        return catalog.with_gap(self.films).withColumn("release_year", F.year("release_date"))

    @cached_property
    def articles(self) -> DataFrame:
        key = F.col("o_orderkey")
        name = F.col("p_name")
        shape = key % 6
        headline = (
            F.when(shape == 0, F.concat(name, F.lit(" review – a quiet triumph")))
            .when(shape == 1, F.concat(F.lit("Review: '"), name, F.lit("' is a marvel")))
            .when(shape == 2, F.concat(name, F.lit(": the return review – louder")))
            .when(shape == 3, F.concat(name, F.lit(" - a second look")))
            .when(shape == 4, F.concat(F.upper(name), F.lit(" review")))
            .otherwise("An evening of shorts")
        )
        joined = self.table("orders").join(
            self.table("part").select("p_partkey", "p_name"), F.col("p_partkey") == key % self.table("part").count()
        )
        return joined.select(
            key.alias("article_id"),
            F.when(key % 2 == 0, "src_a").otherwise("src_b").alias("source"),
            headline.alias("headline"),
            F.when(key % 7 != 0, (key % 5 + 1).cast("string")).alias("stars"),
            F.concat(F.lit("By Critic "), (F.col("o_custkey") % 50).cast("string")).alias("byline"),
            F.when(key % 31 == 0, "")
            .otherwise(F.concat(F.lit("Body of article "), key.cast("string")))
            .alias("body"),
            F.col("o_orderdate").cast("date").alias("published"),
        )

    @cached_property
    def score_payloads(self) -> DataFrame:
        key = F.col("p_partkey")
        digits = F.concat_ws(".", (key % 8 + 1).cast("string"), (key % 10).cast("string"))
        critic = F.when(key % 6 == 0, "").otherwise(
            F.concat(
                F.lit(',{"Source":"Rotten Tomatoes","Value":"'),
                (key * 37 % 101).cast("string"),
                F.lit('%"}'),
            )
        )
        answer = F.concat(
            F.lit('{"Response":"True","Ratings":[{"Source":"Internet Movie Database","Value":"7.0/10"}'),
            critic,
            F.lit('],"imdbRating":"'),
            F.when(key % 10 < 3, "N/A").otherwise(digits),
            F.lit('"}'),
        )
        failed = F.lit('{"Response":"False","Error":"not found"}')
        return self.table("part").select(
            F.concat(F.lit("tt"), key.cast("string")).alias("imdb_id"),
            F.when(key % 9 == 0, failed).otherwise(answer).alias("payload"),
        )
