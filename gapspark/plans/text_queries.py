"""Registered queries over texts: aspects, sentiment models, learning from new rows."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gapspark import fixed, session
from gapspark.functions import scores
from gapspark.operators import aspects, classify, linear
from gapspark.plans import model_sql
from gapspark.plans.registry import query

def hits_sql(columns: str) -> str:
    """The rows of ``split`` per aspect with the sentences that hold a keyword."""
    return "\n  UNION ALL\n  ".join(
        f"""SELECT {columns}, '{aspect}' AS aspect, sentences, list_filter(sentences,
    lambda s: regexp_matches(lower(s), '{"|".join(words)}')) AS spoken FROM split"""
        for aspect, words in fixed.ASPECT_KEYWORDS.items()
    )


ASPECTS = f"""
WITH split AS (
  SELECT film_link, source, external_id, review_content, list_filter(list_transform(string_split(
      regexp_replace(trim(review_content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s)), lambda s: length(s) > 10) AS sentences
  FROM fx_reviews),
hits AS ({hits_sql("film_link, source, external_id, review_content")}),
scored AS (
  SELECT *, coalesce(CAST(len(spoken) AS DOUBLE) / nullif(len(sentences), 0), 0) AS confidence
  FROM hits)
"""


def keyed_reviews(v):
    return v.plain_reviews.select("film_link", "source", "external_id", "review_content")


@query(
    "aspect_detect",
    ("fx_reviews",),
    ASPECTS
    + """SELECT film_link, source, external_id, aspect, round(confidence, 6) AS confidence
    FROM scored WHERE confidence > 0.15""",
)
def _aspect_detect(v):
    found = aspects.shared_aspects(keyed_reviews(v), with_text=False, detected=True)
    return found.select(
        "film_link", "source", "external_id", "aspect", F.round("confidence", 6).alias("confidence")
    )


@query(
    "aspect_sentences",
    ("fx_reviews",),
    ASPECTS
    + """SELECT film_link, source, external_id, aspect, confidence > 0.15 AS detected,
      CASE WHEN len(spoken) > 0 THEN array_to_string(spoken[1:3], ' ') ELSE review_content END
        AS judged_text FROM scored""",
)
def _aspect_sentences(v):
    rows = aspects.shared_aspects(keyed_reviews(v))
    return rows.select("film_link", "source", "external_id", "aspect", "detected", "judged_text")


@query(
    "film_aspects",
    ("fx_reviews",),
    ASPECTS
    + """SELECT film_link, aspect, count(*) AS reviews, round(avg(confidence), 6) AS confidence
    FROM scored WHERE confidence > 0.15 GROUP BY film_link, aspect""",
)
def _film_aspects(v):
    return (
        aspects.shared_aspects(keyed_reviews(v), with_text=False, detected=True)
        .groupBy("film_link", "aspect")
        .agg(F.count("*").alias("reviews"), F.round(F.avg("confidence"), 6).alias("confidence"))
    )


@query(
    "document_aspects",
    (),
    """WITH split AS (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(
          trim(text, chr(9) || chr(10) || chr(13) || ' '),
          '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
          lambda s: trim(s, chr(9) || chr(10) || chr(13) || ' ')), lambda s: length(s) > 10)
        AS sentences FROM documents),
    hits AS ("""
    + hits_sql("doc_id")
    + """)
    SELECT doc_id, aspect,
      round(coalesce(CAST(len(spoken) AS DOUBLE) / nullif(len(sentences), 0), 0), 6) AS confidence
    FROM hits""",
)
def _document_aspects(v):
    # the table may be one row group, which one task reads; the others join in analysing
    documents = v.table("documents").select("doc_id", "text").repartition("doc_id", "text")
    rows = aspects.aspect_rows(documents, "text", None, with_text=False)
    return rows.select("doc_id", "aspect", F.round("confidence", 6).alias("confidence"))


# Stars derived from order lines stand in for a model's, so that the vote is checkable.
@query(
    "overall_sentiment",
    (),
    """WITH stars AS (SELECT l_orderkey, CAST(l_quantity AS INT) % 5 + 1 AS stars,
      l_discount > 0.02 AS detected FROM lineitem),
    votes AS (SELECT l_orderkey, count(*) FILTER (detected AND stars > 3) AS positive,
      count(*) FILTER (detected AND stars <= 2) AS negative,
      count(*) FILTER (detected AND stars = 3) AS neutral FROM stars GROUP BY l_orderkey)
    SELECT *, CASE WHEN positive > negative AND positive > neutral THEN 'Positive'
      WHEN negative > positive AND negative > neutral THEN 'Negative' ELSE 'Mixed' END AS overall
    FROM votes""",
)
def _overall_sentiment(v):
    stars = F.col("l_quantity").cast("int") % 5 + 1
    judged = v.table("lineitem").select(
        "l_orderkey",
        (F.col("l_discount") > 0.02).alias("detected"),
        scores.stars_to_sentiment(stars).alias("sentiment"),
    )
    return aspects.overall_by(judged, ["l_orderkey"])


@query(
    "ensemble",
    (),
    """WITH opinions AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN l_tax >= 0.04 THEN 'Positive' ELSE 'Negative' END AS fast_label,
      round(0.5 + l_discount * 4, 4) AS fast_confidence,
      CASE WHEN l_quantity >= 25 THEN 'Positive' ELSE 'Negative' END AS deep_label,
      round(0.5 + l_quantity / 100, 4) AS deep_confidence FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CASE WHEN fast_label = deep_label THEN fast_label ELSE deep_label END AS sentiment,
      round(CASE WHEN fast_label = deep_label THEN (fast_confidence + deep_confidence) / 2
        ELSE deep_confidence * 0.82 END, 3) AS confidence,
      fast_label = deep_label AS agreement,
      CASE WHEN fast_label = deep_label THEN 'ensemble' ELSE 'ensemble_disagreement' END AS model
    FROM opinions""",
)
def _ensemble(v):
    opinions = v.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(F.col("l_tax") >= 0.04, "Positive").otherwise("Negative").alias("fast_label"),
        F.round(F.lit(0.5) + F.col("l_discount") * 4, 4).alias("fast_confidence"),
        F.when(F.col("l_quantity") >= 25, "Positive").otherwise("Negative").alias("deep_label"),
        F.round(F.lit(0.5) + F.col("l_quantity") / 100, 4).alias("deep_confidence"),
    )
    merged = classify.with_ensemble(opinions).withColumn("confidence", F.round("confidence", 3))
    return merged.drop("fast_label", "fast_confidence", "deep_label", "deep_confidence")


@query(
    "unscored_reviews",
    ("fx_reviews",),
    """SELECT film_link, source, external_id FROM fx_reviews r
    WHERE review_content <> '' AND NOT EXISTS (SELECT 1 FROM fx_reviews s
      WHERE s.review_date < DATE '2000-01-01' AND s.film_link = r.film_link
        AND s.source = r.source AND s.external_id = r.external_id)""",
)
def _unscored_reviews(v):
    stored = v.plain_reviews.where("review_date < '2000-01-01'").select(*classify.SENTIMENT_KEY)
    return classify.unscored_reviews(v.plain_reviews, stored).select(*classify.SENTIMENT_KEY)


def labelled_documents(v):
    """Documents with their quality label, the larger labelled corpus here."""
    documents = v.table("documents")
    return documents.join(v.table("labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").cast("double").alias("label")
    )


@query(
    "stratified_split",
    (),
    """WITH ranked AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality
        ORDER BY md5(CAST(doc_id AS STRING) || '#42'), CAST(doc_id AS STRING)) AS place,
        count(*) OVER (PARTITION BY quality) AS n
      FROM labels JOIN documents USING (doc_id))
    SELECT doc_id, CASE WHEN place <= floor(n * 0.8E0) THEN 'train'
      WHEN place <= floor(n * (0.8E0 + 0.1E0)) THEN 'val' ELSE 'test' END AS split
    FROM ranked""",
)
def _stratified_split(v):
    rated = labelled_documents(v).select("doc_id", "label")
    return classify.stratified_split(rated, "doc_id", "label").select("doc_id", "split")


@query(
    "review_split",
    ("fx_reviews",),
    """WITH ids AS (SELECT DISTINCT film_link || '|' || source || '|' || external_id AS review_id,
        label FROM fx_reviews),
      ranked AS (SELECT review_id, row_number() OVER (PARTITION BY label
        ORDER BY md5(review_id || '#42'), review_id) AS place,
        count(*) OVER (PARTITION BY label) AS n FROM ids)
    SELECT review_id, CASE WHEN place <= floor(n * 0.8E0) THEN 'train'
      WHEN place <= floor(n * (0.8E0 + 0.1E0)) THEN 'val' ELSE 'test' END AS split
    FROM ranked""",
)
def _review_split(v):
    ids = v.plain_reviews.select(
        F.concat_ws("|", "film_link", "source", "external_id").alias("review_id"), "label"
    ).distinct()
    return classify.stratified_split(ids, "review_id", "label").select("review_id", "split")


@query(
    "replay_mix",
    (),
    """WITH fresh AS (SELECT doc_id FROM labels WHERE toxic = 1),
    olds AS (SELECT doc_id FROM labels WHERE toxic = 0
      ORDER BY md5(CAST(doc_id AS STRING) || '#42'), doc_id
      LIMIT (SELECT least(count(*) * 5, 500) FROM fresh))
    SELECT doc_id, 'new' AS origin FROM fresh WHERE (SELECT count(*) FROM fresh) >= 20
    UNION ALL
    SELECT doc_id, 'replay' FROM olds WHERE (SELECT count(*) FROM fresh) >= 20""",
)
def _replay_mix(v):
    rows = v.table("labels").select("doc_id", "toxic")
    buffer = rows.where("toxic = 1").select("doc_id")
    originals = rows.where("toxic = 0").select("doc_id")
    mixed = classify.retrain_set(buffer, originals, "doc_id")
    if mixed is None:
        return buffer.limit(0).withColumn("origin", F.lit("new"))
    return mixed


STEP = """
WITH corpus AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS words,
    CAST(quality AS DOUBLE) AS label FROM documents JOIN labels USING (doc_id)),
counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(words) AS term FROM corpus) GROUP BY doc_id, term),
weights AS MATERIALIZED (SELECT term, ln(((SELECT count(*) FROM corpus) + 1) / (count(*) + 1)) + 1 AS idf
  FROM counts GROUP BY term),
raws AS MATERIALIZED (SELECT doc_id, term, (ln(tf) + 1) * idf AS raw FROM counts JOIN weights USING (term)),
vals AS MATERIALIZED (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS x FROM raws),
w1 AS MATERIALIZED (SELECT term, -2.0E0 * sum(x * (0.5E0 - label)) / (SELECT count(*) FROM corpus) AS w
  FROM vals JOIN corpus USING (doc_id) GROUP BY term),
errors AS MATERIALIZED (SELECT doc_id, 1 / (1 + exp(-sum(x * w))) AS p FROM vals JOIN w1 USING (term)
  GROUP BY doc_id),
slopes AS MATERIALIZED (SELECT term, sum(x * (p - label)) / (SELECT count(*) FROM corpus) AS slope
  FROM vals JOIN errors USING (doc_id) JOIN corpus USING (doc_id) GROUP BY term)
SELECT term, round(w - 2.0E0 * slope, 6) AS w FROM w1 JOIN slopes USING (term)
"""


@query("incremental_step", (), STEP)
def _incremental_step(v):
    """Texts are read and counted once. The values lie in buckets of their documents, so a
    step moves them for the terms' weights only, and no step is computed again by the next."""
    corpus = labelled_documents(v)
    labels = session.written(corpus.select("doc_id", "label"), "labels")
    counts, parts = classify.counted_terms(corpus, "doc_id", "text")
    idf = classify.counted_weights(counts, labels.count())
    values = classify.counted_values(counts, "doc_id", idf, parts)
    weights = idf.select("term", F.lit(0.0).alias("w"))
    with session.bucketed(values, "doc_id", "values", parts) as placed:
        for _ in range(2):
            weights = session.written(classify.gradient_step(weights, placed, labels, "doc_id", rate=2.0), "weights")
    return weights.select("term", F.round("w", 6).alias("w"))


SPLIT_ROWS = [
    model_sql.cte("ranked", """SELECT doc_id, coalesce(text, '') AS text, quality AS label,
      row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS STRING) || '#42'), CAST(doc_id AS STRING)) AS place,
      count(*) OVER (PARTITION BY quality) AS size FROM labels JOIN documents USING (doc_id)"""),
    model_sql.cte("parted", """SELECT doc_id, text, label, CASE WHEN place <= floor(size * 0.8E0) THEN 'train'
      WHEN place <= floor(size * (0.8E0 + 0.1E0)) THEN 'val' ELSE 'test' END AS split FROM ranked"""),
    model_sql.cte("train", "SELECT text, label FROM parted WHERE split = 'train'"),
]


def split_documents(v):
    return classify.stratified_split(labelled_documents(v), "doc_id", "label")


@query(
    "classifier_accuracy",
    (),
    model_sql.with_clause(
        SPLIT_ROWS, model_sql.fit("model", "train"),
        model_sql.cte("texts", "SELECT DISTINCT md5(text) AS key, text FROM parted"),
        model_sql.scores("scored", "texts", "model"),
        model_sql.cte("judged", f"""SELECT split, label, unnest([{{'model': '{fixed.MODEL_FAST}', 'p': fast}},
          {{'model': '{fixed.MODEL_DEEP}', 'p': deep}}]) AS o FROM parted JOIN scored ON scored.key = md5(text)"""),
    )
    + """SELECT split, o.model AS model, count(*) AS samples,
      round_even(count(*) FILTER ((o.p >= 0.5) = (label = 1)) / count(*), 4) AS accuracy FROM judged GROUP BY split, o.model""",
)
def _classifier_accuracy(v):
    rows = split_documents(v)
    return linear.accuracy(linear.fit(rows.where("split = 'train'")), rows)


@query(
    "incremental_scores",
    (),
    model_sql.with_clause(
        SPLIT_ROWS, model_sql.fit("model", "train"),
        model_sql.cte("fresh", "SELECT text, label FROM parted WHERE split = 'val'"),
        model_sql.rated("batch", "fresh"),
        model_sql.cte("known", "SELECT term, factor FROM model"),
        model_sql.values("batch_values", "batch", "known"),
        model_sql.cte("start", "SELECT term, w FROM model_fast"),
        model_sql.steps("learnt", "start", "batch_values", "batch", 2, linear.RATE, linear.PENALTY),
        model_sql.cte("texts", "SELECT DISTINCT md5(text) AS key, text FROM parted"),
        model_sql.scores("before", "texts", "model"),
        model_sql.scores("after", "texts", "model", "learnt"),
    )
    + """SELECT doc_id, round(b.fast, 6) AS before, round(a.fast, 6) AS after, a.fast >= 0.5 AS positive
    FROM parted JOIN before b ON b.key = md5(text) JOIN after a ON a.key = b.key""",
)
def _incremental_scores(v):
    """One model answers, learns from rows it had not seen, and answers differently."""
    rows = split_documents(v)
    before = linear.fit(rows.where("split = 'train'"))
    after = linear.learn(before, rows.where("split = 'val'"), steps=2)
    scored = after.probability(before.probability(rows, "text", "before"), "text", "after")
    return scored.select(
        "doc_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), (F.col("after") >= 0.5).alias("positive")
    )


def review_models(v):
    """Both opinions, fitted on all labelled reviews."""
    return linear.fit(v.plain_reviews, "review_content", "label")


REVIEW_MODEL = [
    model_sql.cte("review_rows", "SELECT film_link, source, external_id, review_content AS text, label FROM fx_reviews"),
    model_sql.fit("model", "review_rows"),
    model_sql.cte("texts", "SELECT DISTINCT md5(text) AS key, text FROM review_rows"),
]


@query(
    "review_sentiment",
    ("fx_reviews",),
    model_sql.with_clause(
        REVIEW_MODEL, model_sql.scores("scored", "texts", "model"),
        model_sql.cte("labelled", f"SELECT film_link, source, external_id, {model_sql.opinions()} FROM review_rows JOIN scored ON key = md5(text)"),
    )
    + f"SELECT film_link, source, external_id, {model_sql.ENSEMBLE} FROM labelled",
)
def _review_sentiment(v):
    opinions = review_models(v).ensemble(keyed_reviews(v), "review_content")
    return opinions.drop("review_content")


def fixed_scorer():
    """Stands for a model that is loaded once per worker: judges by a text's length."""
    def judge(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        return pa.array(["Positive" if n % 2 == 0 else "Negative" for n in size]), pa.array(0.5 + size % 100 / 250)

    return judge


@query(
    "external_opinion",
    (),
    """WITH o AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, CASE WHEN text <> '' THEN CASE WHEN length(text) % 2 = 0 THEN 'Positive' ELSE 'Negative' END END AS deep_label,
      CASE WHEN text <> '' THEN round(0.5 + length(text) % 100 / 250, 4) END AS deep_confidence FROM o""",
)
def _external_opinion(v):
    documents = v.table("documents").select("doc_id", "text")
    judged = classify.VectorModel(fixed_scorer, "length").opinion(documents, "text", "deep_label", "deep_confidence")
    known = F.col("text") != ""
    return judged.select("doc_id", *(F.when(known, F.col(c)).alias(c) for c in ("deep_label", "deep_confidence")))


#: Detected aspects of the distinct review texts, judged by the fast opinion.
JUDGED = [
    REVIEW_MODEL,
    model_sql.cte("split", """SELECT key, text, list_filter(list_transform(string_split(
      regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 10) AS sentences
      FROM texts"""),
    model_sql.cte("hits", hits_sql("key, text")),
    model_sql.cte("shares", """SELECT *, coalesce(CAST(len(spoken) AS DOUBLE) / nullif(len(sentences), 0), 0) AS confidence FROM hits"""),
    model_sql.cte("asked", """SELECT key AS text_key, aspect, array_to_string(spoken[1:3], ' ') AS text FROM shares WHERE confidence > 0.15"""),
    model_sql.cte("spans", "SELECT DISTINCT md5(text) AS key, text FROM asked"),
    model_sql.scores("spoken_scores", "spans", "model"),
    model_sql.cte("judged", """SELECT text_key, aspect, stars, CASE WHEN stars <= 2 THEN 'Negative' WHEN stars = 3 THEN 'Neutral' ELSE 'Positive' END
        AS sentiment, round(greatest(fast, 1 - fast), 4) AS sentiment_confidence
      FROM (SELECT text_key, aspect, fast, CAST(least(5, 1 + floor(5 * fast)) AS INTEGER) AS stars
        FROM asked JOIN spoken_scores ON key = md5(text))"""),
]


@query(
    "aspect_stars",
    ("fx_reviews",),
    model_sql.with_clause(*JUDGED)
    + """SELECT film_link, source, external_id, aspect, stars, sentiment, sentiment_confidence
    FROM review_rows JOIN judged ON text_key = md5(text)""",
)
def _aspect_stars(v):
    return aspects.aspect_stars(keyed_reviews(v), list(classify.SENTIMENT_KEY), review_models(v))


@query(
    "review_analysis",
    ("fx_reviews",),
    model_sql.with_clause(
        *JUDGED, model_sql.scores("scored", "texts", "model"),
        model_sql.cte("votes", """SELECT text_key, count(*) AS detected, count(*) FILTER (sentiment = 'Positive') AS positive,
          count(*) FILTER (sentiment = 'Negative') AS negative, count(*) FILTER (sentiment = 'Neutral') AS neutral FROM judged GROUP BY text_key"""),
        model_sql.cte("labelled", f"SELECT film_link, source, external_id, key, {model_sql.opinions()} FROM review_rows JOIN scored ON key = md5(text)"),
    )
    + f"""SELECT film_link, source, external_id, CASE WHEN positive > negative AND positive > neutral THEN 'Positive'
      WHEN negative > positive AND negative > neutral THEN 'Negative' ELSE 'Mixed' END AS overall,
      8 AS aspects, CAST(coalesce(detected, 0) AS INTEGER) AS detected, {model_sql.VERDICT}
    FROM labelled LEFT JOIN votes ON text_key = key""",
)
def _review_analysis(v):
    analysed = aspects.review_analysis(keyed_reviews(v), list(classify.SENTIMENT_KEY), review_models(v))
    return analysed.select(
        *classify.SENTIMENT_KEY,
        "overall",
        F.size("aspects").alias("aspects"),
        F.size(F.filter("aspects", lambda a: a["confidence"] > fixed.ASPECT_MIN_CONFIDENCE)).alias(
            "detected"
        ),
        "sentiment",
        "confidence",
        "agreement",
        "model",
    )


@query(
    "sentiment_store",
    ("fx_reviews",),
    model_sql.with_clause(
        REVIEW_MODEL, model_sql.scores("scored", "texts", "model"),
        model_sql.cte("known", """SELECT DISTINCT film_link, source, CASE WHEN film_id % 5 = 0 THEN NULL ELSE external_id END AS external_id,
          review_content AS text FROM fx_reviews"""),
        model_sql.cte("labelled", f"SELECT film_link, source, external_id, {model_sql.opinions()} FROM known JOIN scored ON key = md5(text)"),
    )
    + """SELECT film_link, source, external_id, fast_label, fast_c / 10000.0E0 AS fast_confidence, deep_label,
      deep_c / 10000.0E0 AS deep_confidence FROM labelled""",
)
def _sentiment_store(v):
    """The reviews before 2000, all of them, that run again, one with nothing new, a fold,
    and the last run once more. One film in five has reviews without ids."""
    models = review_models(v)
    known = F.when(F.col("film_id") % 5 != 0, F.col("external_id"))
    reviews = v.plain_reviews.withColumn("external_id", known)
    log = classify.sentiment_log(v.spark, session.fresh_path(v.spark, "sentiments"))
    classify.store_sentiment(log, reviews.where("review_date < '1995-01-01'"), models, 0)
    for run in (1, 1, 2):
        classify.store_sentiment(log, reviews, models, run)
    log.compact()
    classify.store_sentiment(log, reviews, models, 2)
    return log.read().drop(classify.REVIEW_ID)
