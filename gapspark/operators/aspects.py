"""Aspects of a review: which of eight are spoken of, and in what tone.

The confidence of an aspect is the share of a review's sentences that hold one of
its keywords. This stands in for a zero-shot language model: thresholds, clips
and result shapes are the same, the confidences are not comparable.

All of it is row-local: sentences stay an array inside the row and the eight
aspects come from one ``inline``, so no join and no shuffle is needed.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import scores, text
from gapspark.session import cut_lineage, written

ASPECTS = tuple(fixed.ASPECT_KEYWORDS)


def deciding_keywords(aspect: str) -> list[str]:
    """Keywords of an aspect without those that contain another one of it."""
    words = fixed.ASPECT_KEYWORDS[aspect]
    return [w for w in words if not any(o != w and o in w for o in words)]


def speaks_of(lowered: Column, aspect: str) -> Column:
    """Any keyword anywhere, also inside a word: plain byte searches, no regex."""
    return reduce(or_, (F.contains(lowered, F.lit(w)) for w in deciding_keywords(aspect)))


def _marked(sentences: Column) -> Column:
    """Sentences with one bit per aspect they speak of."""
    def mask(lowered: Column) -> Column:
        bits = (
            F.when(speaks_of(lowered, aspect), 1 << i).otherwise(0)
            for i, aspect in enumerate(ASPECTS)
        )
        return reduce(add, bits)

    both = F.arrays_zip(
        sentences.alias("text"), F.transform(sentences, F.lower).alias("lowered")
    )
    return F.transform(
        both, lambda s: F.struct(s["text"].alias("text"), mask(s["lowered"]).alias("mask"))
    )


def _speaking(marked: Column, bit: int) -> Column:
    return F.filter(marked, lambda m: m["mask"].bitwiseAND(F.lit(1 << bit)) != 0)


def with_aspects(
    reviews: DataFrame,
    content: str = "review_content",
    max_words: int | None = None,
    with_text: bool = True,
    start_words: int | None = None,
    max_chars: int | None = None,
    out: str = "_aspects",
) -> DataFrame:
    """Adds an array of the eight aspects: aspect, confidence, the text to judge, detected.

    Confidence looks at the first ``max_words`` words (None: all), the judged text
    is the first three speaking sentences of the whole review, or the review (its
    first ``start_words`` words) when none speaks, cut to ``max_chars`` characters if
    given; ``with_text`` off leaves it out.
    """
    body = F.coalesce(content, F.lit(""))
    marked = reviews.withColumn("_sentences", text.long_sentences(body)).withColumn(
        "_marked", _marked(F.col("_sentences"))
    )
    has_clip = max_words is not None
    if has_clip:
        clipped = _marked(text.long_sentences(text.clip_words(body, max_words)))
        marked = marked.withColumn("_clipped", F.when(~text.within_words(body, max_words), clipped))
    if with_text:
        marked = marked.withColumn(
            "_start",
            text.clip_words(body, start_words),
        )
    spoken = {f"_spoken{i}": _speaking(F.col("_marked"), i) for i in range(len(ASPECTS))}
    parted = marked.withColumns(spoken)

    def row(bit: int, aspect: str) -> Column:
        own = F.col(f"_spoken{bit}")
        hits, total = F.size(own), F.size("_marked")
        if has_clip:
            short = F.col("_clipped").isNull()
            hits = F.when(short, hits).otherwise(F.size(_speaking(F.col("_clipped"), bit)))
            total = F.when(short, total).otherwise(F.size("_clipped"))
        share = F.coalesce(F.try_divide(hits.cast("double"), total), F.lit(0.0))
        fields = [F.lit(aspect).alias("aspect"), share.alias("confidence")]
        if with_text:
            first = F.slice(own, 1, fixed.ASPECT_SENTENCES)
            said = F.array_join(F.transform(first, lambda m: m["text"]), " ")
            judged = F.when(F.size(own) > 0, said).otherwise(F.col("_start"))
            fields.append(text.clip_chars(judged, max_chars).alias("judged_text"))
        return F.struct(*fields)

    rows = F.array(*(row(i, a) for i, a in enumerate(ASPECTS)))
    return parted.select(*reviews.columns, rows.alias(out))


def aspect_rows(
    reviews: DataFrame,
    content: str = "review_content",
    max_words: int | None = None,
    with_text: bool = True,
    start_words: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Eight rows per review, as ``with_aspects`` finds them: aspect, confidence, the text
    to judge and whether the aspect is detected."""
    marked = with_aspects(reviews, content, max_words, with_text, start_words, max_chars)
    # there are always eight; an outer inline gets no filter on their number, which would be
    # moved to the scan and analyse every text there, many times over
    exploded = marked.select(*reviews.columns, F.inline_outer("_aspects"))
    return exploded.withColumn(
        "detected", F.col("confidence") > fixed.ASPECT_MIN_CONFIDENCE
    )


def detected_aspects(
    reviews: DataFrame,
    content: str = "review_content",
    max_words: int | None = None,
) -> DataFrame:
    """Aspects a review speaks of with enough confidence."""
    rows = aspect_rows(reviews, content, max_words, with_text=False)
    return rows.where("detected").drop("detected")


def shared_aspects(
    reviews: DataFrame,
    content: str = "review_content",
    with_text: bool = True,
    detected: bool = False,
) -> DataFrame:
    """The reviews' other columns with their aspect rows, as ``aspect_rows`` finds them
    (only the detected ones, if asked); equal texts are analysed once.

    The distinct texts are analysed over all cores, whatever partitions the reviews come
    in, and stored, so that the join back is a broadcast by measured size where they are
    few. Other columns than the text never travel for it.
    """
    others = [c for c in reviews.columns if c != content]
    body = F.coalesce(content, F.lit(""))
    texts = reviews.select(body.alias("text")).distinct()
    rows = with_aspects(texts.repartition("text"), "text", with_text=with_text)
    is_detected = lambda a: a["confidence"] > fixed.ASPECT_MIN_CONFIDENCE
    kept = F.filter("_aspects", is_detected) if detected else F.col("_aspects")
    found = written(rows.select(F.md5("text").alias("_text_id"), kept.alias("_aspects")), "aspects")
    keyed = reviews.select(*others, F.md5(body).alias("_text_id"))
    exploded = keyed.join(found, "_text_id").select(*others, F.inline("_aspects"))
    if detected:
        return exploded
    return exploded.withColumn("detected", F.col("confidence") > fixed.ASPECT_MIN_CONFIDENCE)


def overall_sentiment(positive: Column, negative: Column, neutral: Column) -> Column:
    """Strict majority of the detected aspects; everything else is mixed."""
    return (
        F.when((positive > negative) & (positive > neutral), "Positive")
        .when((negative > positive) & (negative > neutral), "Negative")
        .otherwise("Mixed")
    )


def overall_by(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Overall sentiment per review from its aspect rows; ``keys`` must name one review.

    The rows of one review start in one partition, so they combine to one row
    before the shuffle.
    """
    def votes(word: str) -> Column:
        return F.count_if(F.col("detected") & (F.col("sentiment") == word))

    counted = judged.groupBy(*keys).agg(
        votes("Positive").alias("positive"),
        votes("Negative").alias("negative"),
        votes("Neutral").alias("neutral"),
    )
    return counted.withColumn(
        "overall",
        overall_sentiment(F.col("positive"), F.col("negative"), F.col("neutral")),
    )


def judgement(detected: Column, p: Column) -> dict[str, Column]:
    """Stars, sentiment and confidence; an undetected aspect is neutral with three stars."""
    stars = F.when(detected, scores.probability_to_stars(p)).otherwise(3)
    sure = F.bround(F.greatest(p, 1 - p), 4)
    return {
        "stars": stars,
        "sentiment": scores.stars_to_sentiment(stars),
        "sentiment_confidence": F.when(detected, sure).otherwise(0.0),
    }


def judge_aspects(rows: DataFrame, model) -> DataFrame:
    """Stars and sentiment of every aspect row from a model's positive probability.

    Only detected aspects are scored; the others are neutral with three stars and no
    confidence, and their text to judge is empty.
    """
    scored = model.probability(rows.where("detected"), "judged_text", "_p")
    others = rows.where("NOT detected").withColumns(
        {"judged_text": F.lit(""), "_p": F.lit(None).cast("double")}
    )
    judged = scored.unionByName(others)
    return judged.withColumns(judgement(F.col("detected"), F.col("_p"))).drop("_p")


OPINION_COLUMNS = (
    "fast_label", "fast_confidence", "deep_label", "deep_confidence",
    "sentiment", "confidence", "agreement", "model",
)


def analysed_texts(reviews: DataFrame, models, content: str = "review_content") -> DataFrame:
    """(text_id, aspects, overall) per distinct text of the reviews.

    Equal texts are analysed once. The eight aspects stay an array in the text's row; only
    the sentences of detected ones leave it, to be scored, and a probability comes back.
    """
    body = reviews.select(F.md5(F.coalesce(content, F.lit(""))).alias("text_id"), F.col(content).alias("text"))
    texts = body.groupBy("text_id").agg(F.first("text", ignorenulls=True).alias("text"))
    listed = with_aspects(texts, "text").drop("text")
    listed = cut_lineage(reviews.sparkSession, listed)
    is_detected = lambda a: a["confidence"] > fixed.ASPECT_MIN_CONFIDENCE
    asked = listed.select("text_id", F.inline(F.filter("_aspects", is_detected)))
    scored = models.probability(asked, "judged_text", "_p")
    found = scored.groupBy("text_id").agg(
        F.map_from_entries(F.collect_list(F.struct("aspect", "_p"))).alias("_p_of")
    )

    def judged(a: Column) -> Column:
        fields = judgement(is_detected(a), F.element_at("_p_of", a["aspect"]))
        return F.struct(a["aspect"].alias("aspect"), a["confidence"].alias("confidence"), *(c.alias(n) for n, c in fields.items()))

    rows = listed.join(found, "text_id", "left").select(
        "text_id", F.sort_array(F.transform("_aspects", judged)).alias("aspects")
    )

    def votes(word: str) -> Column:
        return F.size(F.filter("aspects", lambda a: is_detected(a) & (a["sentiment"] == word)))

    return rows.withColumn("overall", overall_sentiment(votes("Positive"), votes("Negative"), votes("Neutral")))


def review_analysis(
    reviews: DataFrame, keys: list[str], models, content: str = "review_content"
) -> DataFrame:
    """One row per review: its eight aspects, overall sentiment and both opinions.

    The key columns need not be unique or known: every review is a row of its own, joined
    to what its text gives.
    """
    opinions = models.ensemble(reviews.select(*keys, content), content)
    keyed = opinions.withColumn("text_id", F.md5(F.coalesce(content, F.lit("")))).drop(content)
    found = analysed_texts(reviews, models, content)
    return keyed.join(found, "text_id").select(*keys, "aspects", "overall", *OPINION_COLUMNS)


def aspect_stars(
    reviews: DataFrame, keys: list[str], models, content: str = "review_content"
) -> DataFrame:
    """One row per review and detected aspect: stars, sentiment and its confidence."""
    found = analysed_texts(reviews, models, content).select("text_id", F.inline("aspects"))
    spoken = found.where(F.col("confidence") > fixed.ASPECT_MIN_CONFIDENCE).drop("confidence")
    keyed = reviews.select(*keys, F.md5(F.coalesce(content, F.lit(""))).alias("text_id"))
    return keyed.join(spoken, "text_id").drop("text_id")
