"""Registered queries over reviews: newest, counts, trend, explanation."""

from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.operators import explain, reviews, trend
from gapspark.plans.fixtures import ASOF
from gapspark.plans.registry import query
from gapspark.session import fresh_path
from gapspark.sources.run_log import RunLog

NEWEST = "review_date DESC NULLS LAST, source, external_id"


@query(
    "latest_reviews",
    ("fx_reviews",),
    f"""SELECT film_link, place, review_date, source, external_id, review_type FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY film_link ORDER BY {NEWEST}) AS INT) AS place
      FROM fx_reviews) WHERE place <= 5""",
)
def _latest_reviews(v):
    slim = v.plain_reviews.select(
        "film_link", "review_date", "source", "external_id", "review_type"
    )
    return reviews.latest_reviews(slim)


@query(
    "film_reviews",
    ("gx_films", "fx_reviews"),
    """SELECT f.film_link, f.movie_title, r.external_id, r.review_date, r.critic_name,
      r.source AS review_source
    FROM gx_films f LEFT JOIN fx_reviews r ON f.film_link = r.film_link""",
)
def _film_reviews(v):
    joined = reviews.film_reviews(
        v.gap_films.select("film_link", "movie_title"),
        v.reviews.select("film_link", "external_id", "review_date", "critic_name", "source"),
    )
    return joined


def labelled(v):
    """Reviews with sentiment labels as an earlier scoring run would have left them."""
    kind = F.col("review_type")
    return v.plain_reviews.withColumns(
        {
            "fast_label": F.when(F.col("label") == 1, "Positive").otherwise("Negative"),
            "deep_label": F.when(kind == "n/a", "").when(kind == "Rotten", "NEGATIVE"),
        }
    )


STATS = """
WITH labelled AS (
  SELECT *, CASE WHEN label = 1 THEN 'Positive' ELSE 'Negative' END AS fast_label,
    CASE WHEN review_type = 'n/a' THEN '' WHEN review_type = 'Rotten' THEN 'NEGATIVE' END
      AS deep_label
  FROM fx_reviews),
said AS (SELECT *, coalesce(nullif(deep_label, ''), fast_label) AS tone FROM labelled),
stats AS (
  SELECT film_link, count(*) AS total_reviews,
    count(*) FILTER (review_type = 'Rotten') AS rotten_count,
    count(*) FILTER (review_type = 'Fresh') AS fresh_count,
    count(*) FILTER (tone IN ('NEGATIVE', 'Negative')) AS negative_count,
    count(*) FILTER (tone IN ('POSITIVE', 'Positive')) AS positive_count
  FROM said GROUP BY film_link)
"""


@query(
    "review_stats",
    ("fx_reviews",),
    STATS
    + """SELECT *, CAST(round_even(rotten_count * 100.0E0 / total_reviews, 0) AS INT) AS rotten_pct,
      CAST(round_even(fresh_count * 100.0E0 / total_reviews, 0) AS INT) AS fresh_pct FROM stats""",
)
def _review_stats(v):
    return reviews.review_stats(labelled(v))


@query(
    "review_stats_normalised",
    ("fx_reviews",),
    """SELECT film_link, count(*) AS total_reviews,
      count(*) FILTER (lower(trim(review_type)) = 'rotten') AS rotten_count,
      count(*) FILTER (lower(trim(review_type)) = 'fresh') AS fresh_count
    FROM fx_reviews GROUP BY film_link""",
)
def _review_stats_normalised(v):
    return reviews.review_stats(v.plain_reviews, normalise=True).select(
        "film_link", "total_reviews", "rotten_count", "fresh_count"
    )


@query(
    "review_load_stats",
    ("fx_reviews",),
    """SELECT count(*) FILTER (source = 'src_a') AS src_a_reviews,
      count(*) FILTER (source = 'src_b') AS src_b_reviews,
      count(DISTINCT film_link) AS films_with_reviews
    FROM fx_reviews WHERE review_date >= DATE '2000-10-01'""",
)
def _review_load_stats(v):
    return reviews.review_load_stats(v.plain_reviews, "2000-10-01", ("src_a", "src_b"))


@query(
    "review_load_sketches",
    ("fx_reviews",),
    """WITH exact AS (SELECT count(*) FILTER (source = 'src_a') AS src_a_reviews,
      count(*) FILTER (source = 'src_b') AS src_b_reviews,
      count(DISTINCT film_link) AS films_with_reviews
    FROM fx_reviews WHERE review_date >= DATE '2000-10-01' AND source IN ('src_a', 'src_b'))
    SELECT 'src_a_reviews' AS measure, src_a_reviews AS exact, true AS same FROM exact
    UNION ALL SELECT 'src_b_reviews', src_b_reviews, true FROM exact
    UNION ALL SELECT 'films_with_reviews', films_with_reviews, true FROM exact""",
)
def _review_load_sketches(v):
    """Months are sketched once, in two runs; the merged sketches stand beside exact counts."""
    sources, names = ("src_a", "src_b"), ("src_a_reviews", "src_b_reviews", "films_with_reviews")
    landing = v.plain_reviews.select("film_link", "source", "review_date", F.date_format("review_date", "yyyy-MM").alias("month"))
    runs = RunLog(v.spark, fresh_path(v.spark, "sketch-runs"), "month")
    runs.run(landing, reviews.review_sketches, upto="2001-01")
    runs.run(landing, reviews.review_sketches)
    told = reviews.sketched_load_stats(runs.rows(), "2000-10", sources)
    exact = reviews.review_load_stats(v.plain_reviews, "2000-10-01", sources)
    both = exact.withColumn("kind", F.lit("exact")).unionByName(told.withColumn("kind", F.lit("told")))
    long = both.unpivot("kind", list(names), "measure", "n")
    value = {k: F.max(F.when(F.col("kind") == k, F.col("n"))) for k in ("exact", "told")}
    error = F.when(F.col("measure") == "films_with_reviews", reviews.sketch_error()).otherwise(0)
    per = long.groupBy("measure").agg(value["exact"].alias("exact"), value["told"].alias("told"))
    return per.select("measure", "exact", (F.abs(F.col("told") - F.col("exact")) <= error * F.col("exact")).alias("same"))


MONTHLY = """
WITH monthly AS (
  SELECT film_link, CAST(date_trunc('month', review_date) AS DATE) AS month,
    count(*) FILTER (lower(trim(review_type)) = 'fresh') AS fresh_count,
    count(*) FILTER (lower(trim(review_type)) = 'rotten') AS rotten_count,
    fresh_count + rotten_count AS total,
    CASE WHEN fresh_count + rotten_count > 0
      THEN CAST(fresh_count AS DOUBLE) / (fresh_count + rotten_count) END AS fresh_ratio
  FROM fx_reviews GROUP BY film_link, CAST(date_trunc('month', review_date) AS DATE))
"""


@query(
    "monthly_counts",
    ("fx_reviews",),
    MONTHLY
    + """SELECT film_link, strftime(month, '%Y-%m') AS period, fresh_count, rotten_count, total,
      round(fresh_ratio, 6) AS fresh_ratio FROM monthly""",
)
def _monthly_counts(v):
    return trend.monthly_counts(v.plain_reviews).select(
        "film_link",
        F.date_format("month", "yyyy-MM").alias("period"),
        "fresh_count",
        "rotten_count",
        "total",
        F.round("fresh_ratio", 6).alias("fresh_ratio"),
    )


@query(
    "monthly_rolling",
    ("fx_reviews",),
    MONTHLY
    + """SELECT film_link, month, round(avg(fresh_ratio) OVER (PARTITION BY film_link
      ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS fresh_ratio_rolling
    FROM monthly""",
)
def _monthly_rolling(v):
    return trend.monthly_rolling(trend.monthly_counts(v.plain_reviews)).select(
        "film_link", "month", F.round("fresh_ratio_rolling", 6).alias("fresh_ratio_rolling")
    )


@query(
    "chart_points",
    ("fx_reviews",),
    MONTHLY
    + """SELECT film_link, month, round(fresh_ratio, 6) AS fresh_ratio, points FROM (
      SELECT *, count(*) OVER (PARTITION BY film_link) AS points FROM monthly
      WHERE fresh_ratio IS NOT NULL) WHERE points >= 2""",
)
def _chart_points(v):
    return trend.chart_points(trend.monthly_counts(v.plain_reviews)).select(
        "film_link", "month", F.round("fresh_ratio", 6).alias("fresh_ratio"), "points"
    )


# The test as joins over months; p uses a series summed by logarithms.
KENDALL = (
    MONTHLY
    + """,
given AS (SELECT film_link, month, fresh_ratio AS x FROM monthly WHERE fresh_ratio IS NOT NULL),
sizes AS (SELECT film_link, count(*) AS n FROM given GROUP BY film_link HAVING count(*) >= 3),
pairs AS (
  SELECT a.film_link, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s
  FROM given a JOIN given b ON a.film_link = b.film_link AND a.month < b.month
  GROUP BY a.film_link),
ties AS (
  SELECT film_link, sum(t * (t - 1) * (2 * t + 5)) AS tied
  FROM (SELECT film_link, x, CAST(count(*) AS DOUBLE) AS t FROM given GROUP BY film_link, x)
  GROUP BY film_link),
spread AS (
  SELECT film_link, n, s,
    (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tied) / 18 AS var_s
  FROM sizes JOIN pairs USING (film_link) JOIN ties USING (film_link)),
tested AS (
  SELECT *, CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s)
    ELSE 0 END AS z, s / (CAST(n AS DOUBLE) * (n - 1) / 2) AS tau FROM spread),
trends AS (
  SELECT *, CASE WHEN z > 1.959963984540054 THEN 'increasing'
    WHEN z < -1.959963984540054 THEN 'decreasing' ELSE 'no trend' END AS trend,
    CASE WHEN z = 0 THEN 1.0E0 ELSE
      1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 120), lambda i:
        exp(i * ln(2.0E0) + (2 * i + 1) * ln(abs(z) / sqrt(2.0E0))
            - (lgamma(2.0E0 * i + 2) - i * ln(2.0E0) - lgamma(i + 1.0E0))))) END AS p_value
  FROM tested)
"""
)


@query(
    "mann_kendall",
    ("fx_reviews",),
    KENDALL
    + """SELECT film_link, CAST(n AS INT) AS n, s, round(var_s, 6) AS var_s, round(z, 6) AS z,
      round(tau, 6) AS tau, trend FROM trends""",
)
def _mann_kendall(v):
    tested = trend.mann_kendall(trend.film_series(v.plain_reviews))
    return tested.select(
        "film_link", "n", "s", *(F.round(c, 6).alias(c) for c in ("var_s", "z", "tau")), "trend"
    )


@query(
    "trend_p_value",
    ("fx_reviews",),
    KENDALL + "SELECT film_link, round(p_value, 6) AS p_value FROM trends",
)
def _trend_p_value(v):
    tested = trend.mann_kendall(trend.film_series(v.plain_reviews))
    return tested.select("film_link", F.round("p_value", 6).alias("p_value"))


def per_publisher(v):
    """Reviews keyed by film and publisher, undated where the verdict is unknown.

    Most of these keys have too few reviews or dates, so every guard applies.
    """
    return v.reviews.select(
        F.concat_ws(":", "film_link", "publisher_name").alias("film_link"),
        F.when(F.col("review_type") != "n/a", F.col("review_date")).alias("review_date"),
        "review_type",
    )


GUARDS = """
WITH keyed AS (
  SELECT film_link || ':' || publisher_name AS film_link,
    CASE WHEN review_type <> 'n/a' THEN review_date END AS review_date FROM fx_reviews),
wanted AS (SELECT film_link FROM fx_films UNION SELECT film_link FROM keyed),
counted AS (SELECT film_link, count(*) AS total, count(review_date) AS dated,
    count(DISTINCT date_trunc('month', review_date)) AS months
  FROM keyed GROUP BY film_link)
SELECT film_link,
  CASE WHEN total IS NULL THEN 'Data not loaded'
       WHEN total < 3 THEN 'Not enough reviews for temporal analysis (need at least 3)'
       WHEN dated < 3 THEN 'Too many unparseable review dates' END AS warning,
  CASE WHEN total < 3 THEN total WHEN dated < 3 THEN dated END AS review_count,
  total IS NOT NULL AND total >= 3 AND dated >= 3 AND months >= 3 AS tested
FROM wanted LEFT JOIN counted USING (film_link)
"""


@query("trend_guards", ("fx_films",), GUARDS)
def _trend_guards(v):
    keyed = per_publisher(v)
    wanted = v.films.select("film_link").union(keyed.select("film_link")).distinct()
    return trend.film_trends(wanted, keyed).select(
        "film_link", "warning", "review_count", F.col("p_value").isNotNull().alias("tested")
    )


STALE = """
WITH stored AS (
  SELECT film_link, CASE WHEN source = 'backfill' THEN DATE '2001-10-01'
    ELSE DATE '2001-06-01' END AS analysed_on
  FROM gx_films WHERE source <> 'tmdb'),
stale AS (
  SELECT f.film_link FROM gx_films f LEFT JOIN stored t ON f.film_link = t.film_link
  WHERE t.analysed_on IS NULL OR f.reviews_updated_on > t.analysed_on)
"""


def stored_trends(v):
    """Trends as earlier runs left them: none for the films found last, others of two ages."""
    origin = F.col("source")
    newer = F.when(origin == "backfill", "2001-10-01").otherwise("2001-06-01").cast("date")
    return v.gap_films.where(origin != "tmdb").select(
        "film_link",
        F.lit("no trend").alias("trend"),
        F.lit(None).cast("double").alias("p_value"),
        F.lit(None).cast("double").alias("tau"),
        F.lit("stored").alias("warning"),
        F.lit(None).cast("bigint").alias("review_count"),
        newer.alias("analysed_on"),
    )


@query("stale_trends", ("gx_films",), STALE + "SELECT film_link FROM stale")
def _stale_trends(v):
    return trend.stale_films(v.gap_films, stored_trends(v))


@query(
    "refresh_trends",
    ("gx_films", "fx_reviews"),
    KENDALL
    + STALE.replace("\nWITH ", ",\n")
    + f"""SELECT film_link, 'no trend' AS trend, CAST(NULL AS DOUBLE) AS p_value,
      CAST(NULL AS DOUBLE) AS tau, 'stored' AS warning, analysed_on
    FROM stored WHERE film_link NOT IN (SELECT film_link FROM stale)
    UNION ALL
    SELECT s.film_link, coalesce(t.trend, 'no trend'), round(t.p_value, 6), round(t.tau, 6),
      CASE WHEN c.total IS NULL THEN 'Data not loaded'
           WHEN c.total < 3 THEN 'Not enough reviews for temporal analysis (need at least 3)' END,
      DATE '{ASOF}'
    FROM stale s LEFT JOIN trends t USING (film_link)
    LEFT JOIN (SELECT film_link, count(*) AS total FROM fx_reviews GROUP BY film_link) c
      USING (film_link)""",
)
def _refresh_trends(v):
    now = F.lit(ASOF).cast("date")
    refreshed = trend.refresh_trends(v.gap_films, v.plain_reviews, stored_trends(v), now)
    return refreshed.select(
        "film_link",
        "trend",
        F.round("p_value", 6).alias("p_value"),
        F.round("tau", 6).alias("tau"),
        "warning",
        "analysed_on",
    )


def _sql_text(template: str) -> str:
    """A printf template as the pattern of DuckDB's format function."""
    return template.replace("%d", "{}").replace("%%", "%").replace("'", "''")


TEXTS = (
    STATS
    + f""",
joined AS (
  SELECT f.film_link, gap, critic_score, audience_score,
    critic_score IS NOT NULL AND audience_score IS NOT NULL AND gap IS NOT NULL AS has_data,
    coalesce(total_reviews, 0) AS total_reviews, coalesce(rotten_count, 0) AS rotten_count,
    coalesce(fresh_count, 0) AS fresh_count, coalesce(negative_count, 0) AS negative_count,
    coalesce(positive_count, 0) AS positive_count,
    CAST(abs(round_even(gap, 0)) AS INT) AS points,
    CAST(round_even(critic_score, 0) AS INT) AS critic_pct,
    CAST(round_even(audience_score, 0) AS INT) AS audience_pct
  FROM gx_films f LEFT JOIN stats s ON f.film_link = s.film_link),
texts AS (
  SELECT *, CASE
    WHEN total_reviews = 0 THEN format('{_sql_text(fixed.EXPLAIN_NO_REVIEWS)}',
      critic_pct, audience_pct, points)
    WHEN gap < -20 THEN format('{_sql_text(fixed.EXPLAIN_AUDIENCE)}', points, total_reviews,
      rotten_count, CAST(round_even(rotten_count * 100.0E0 / total_reviews, 0) AS INT), audience_pct)
    WHEN gap > 20 THEN format('{_sql_text(fixed.EXPLAIN_CRITICS)}', points, total_reviews,
      fresh_count, CAST(round_even(fresh_count * 100.0E0 / total_reviews, 0) AS INT), audience_pct)
    ELSE format('{_sql_text(fixed.EXPLAIN_AGREE)}', critic_pct, audience_pct, points) END AS words
  FROM joined)
"""
)


@query(
    "explain_stats",
    ("gx_films",),
    TEXTS
    + """SELECT film_link, has_data,
      CASE WHEN has_data THEN total_reviews END AS total_reviews,
      CASE WHEN has_data THEN rotten_count END AS rotten_count,
      CASE WHEN has_data THEN fresh_count END AS fresh_count,
      CASE WHEN has_data THEN negative_count END AS negative_count,
      CASE WHEN has_data THEN positive_count END AS positive_count,
      CASE WHEN has_data THEN CASE WHEN gap < 0 THEN 'audience_higher' ELSE 'critic_higher' END END
        AS direction,
      CASE WHEN has_data THEN points END AS gap_points
    FROM joined""",
)
def _explain_stats(v):
    return explain.explain_texts(v.gap_films, labelled(v)).drop("explanation", "gap")


@query(
    "explain_text",
    ("gx_films",),
    TEXTS + "SELECT film_link, CASE WHEN has_data THEN words END AS explanation FROM texts",
)
def _explain_text(v):
    return explain.explain_texts(v.gap_films, labelled(v)).select("film_link", "explanation")


@query(
    "explain_text_without_reviews",
    ("gx_films",),
    TEXTS
    + f"""SELECT film_link, CASE WHEN has_data THEN format('{_sql_text(fixed.EXPLAIN_NO_REVIEWS)}',
      critic_pct, audience_pct, points) END AS explanation FROM joined""",
)
def _explain_text_without_reviews(v):
    none_yet = labelled(v).where(F.col("review_date") > ASOF)
    return explain.explain_texts(v.gap_films, none_yet).select("film_link", "explanation")


@query(
    "explained_films",
    ("gx_films",),
    TEXTS + "SELECT film_link, points AS gap_points FROM texts WHERE has_data AND points >= 15",
)
def _explained_films(v):
    shown = explain.worth_showing(explain.explain_texts(v.gap_films, labelled(v)))
    return shown.select("film_link", "gap_points")


QUOTES = f"""
WITH marked AS (
  SELECT *, string_split(regexp_replace(trim(review_content), '([.!?])\\s+', '\\1' || chr(1), 'g'),
    chr(1)) AS parts
  FROM fx_reviews),
quoted AS (
  SELECT *, list_filter(list_transform(parts, lambda p: trim(trim(p), '"''')),
    lambda q: length(q) BETWEEN 30 AND 200 AND NOT starts_with(lower(q), 'read'))[1] AS quote
  FROM marked),
placed AS (
  SELECT q.*, f.gap,
    row_number() OVER (PARTITION BY q.film_link, q.review_type ORDER BY {NEWEST}) AS of_type,
    row_number() OVER (PARTITION BY q.film_link ORDER BY {NEWEST}) AS of_all
  FROM quoted q JOIN (SELECT film_link, gap FROM gx_films WHERE gap IS NOT NULL) f
    ON q.film_link = f.film_link),
turns AS (
  SELECT *, CASE
    WHEN gap < -20 THEN CASE WHEN review_type = 'Rotten' AND of_type <= 12 THEN of_type
                             WHEN review_type = 'Fresh' AND of_type <= 4 THEN 12 + of_type END
    WHEN gap > 20 THEN CASE WHEN review_type = 'Fresh' AND of_type <= 12 THEN of_type
                            WHEN review_type = 'Rotten' AND of_type <= 4 THEN 12 + of_type END
    ELSE CASE WHEN of_all <= 10 THEN of_all END END AS turn
  FROM placed)
SELECT film_link, CAST(place AS INT) AS place, quote AS quote_text, critic_name AS critic,
  publisher_name AS publisher, review_type AS quote_type
FROM (SELECT *, row_number() OVER (PARTITION BY film_link ORDER BY turn) AS place
      FROM turns WHERE turn IS NOT NULL AND quote IS NOT NULL)
WHERE place <= 3
"""


@query("explain_quotes", ("gx_films",), QUOTES)
def _explain_quotes(v):
    return explain.quotes(v.gap_films, v.reviews)
