"""Edge values of the column functions."""

import datetime as dt

import pytest
from frames import values
from pyspark.sql import functions as F

from gapspark import fixed
from gapspark.functions import dates, scores, stats, text
from gapspark.operators import aspects, classify


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "gap, label",
    [
        (20.0, fixed.LABEL_ALIGNED),
        (20.01, fixed.LABEL_CRITICS),
        (-20.0, fixed.LABEL_ALIGNED),
        (-20.01, fixed.LABEL_AUDIENCE),
        (None, fixed.LABEL_ALIGNED),
    ],
)
def test_label_bounds(spark, gap, label):
    assert one(spark, scores.gap_label(F.lit(gap).cast("double"))) == label


@pytest.mark.parametrize("gap, points", [(20.5, 20), (21.5, 22), (-20.5, 20), (0.0, 0)])
def test_gap_points_round_half_even(spark, gap, points):
    assert one(spark, scores.gap_points(F.lit(gap))) == points


HEADLINES = [
    ("Review: 'Oppenheimer' Is a Magnificent Achievement", "Review"),
    ("Review: 'Oppenheimer' is a magnificent achievement", "Oppenheimer"),
    ("review – “Past Lives” takes its time", "Past Lives"),
    ("Up review", "Up review"),
    ("Dune: Part Two review – a visually stunning sequel", "Dune: Part Two"),
    ("'Tar' – a study", "Tar"),
    ("Alien - the return", "Alien"),
    ("Heat: a city burns", "Heat"),
    ("Review: The island", "The"),
    ("x" * 79 + " tail", "x" * 79 + " tail"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("headline, title", HEADLINES)
def test_headline_title(spark, headline, title):
    assert one(spark, text.headline_title(F.lit(headline).cast("string"))) == title


def test_headline_title_strict(spark):
    strict = text.headline_title(F.lit("Review: 'Oppenheimer' Is a Marvel"), strict=True)
    assert one(spark, strict) == "Oppenheimer"
    whole_word = text.headline_title(F.lit("Review: The island"), strict=True)
    assert one(spark, whole_word) == "Review"


@pytest.mark.parametrize(
    "stars, kind", [(None, "Fresh"), ("", "Fresh"), ("3", "Fresh"), ("2", "Rotten"), ("5", "Fresh")]
)
def test_stars_to_type(spark, stars, kind):
    assert one(spark, scores.stars_to_type(F.lit(stars).cast("string"))) == kind


def test_stars_to_sentiment(spark):
    rows = spark.range(1, 6).select(scores.stars_to_sentiment(F.col("id")))
    assert [r[0] for r in values(rows)] == [
        "Negative", "Negative", "Neutral", "Positive", "Positive",
    ]


def test_probability_to_stars(spark):
    rows = spark.createDataFrame([(0.0,), (0.19,), (0.2,), (0.5,), (0.99,), (1.0,)], "p double")
    assert [r[0] for r in values(rows.select(scores.probability_to_stars(F.col("p"))))] == [
        1, 1, 2, 3, 5, 5,
    ]


def sentence(n, start="S"):
    return start + "a" * (n - len(start) - 1) + "."


@pytest.mark.parametrize(
    "content, quote",
    [
        (f"{sentence(29)} {sentence(30)}", sentence(30)),
        (f"{sentence(201)} {sentence(200)}", sentence(200)),
        (f"{sentence(40, 'Read more ')} {sentence(35)}", sentence(35)),
        (f'  "{sentence(40)}"  ', sentence(40)),
        ("Too short. Also short.", None),
        ("", None),
        (None, None),
        (sentence(30) + " " + sentence(31), sentence(30)),
    ],
)
def test_first_quote(spark, content, quote):
    assert one(spark, text.first_quote(F.lit(content).cast("string"))) == quote


def test_strip_knows_all_white_space(spark):
    assert one(spark, text.strip(F.lit(" \x1c a b　\n"))) == "a b"
    assert one(spark, text.blank_to_null(F.lit(" \t "))) is None


@pytest.mark.parametrize(
    "raw, shown", [(" fresh ", "Fresh"), ("ROTTEN", "Rotten"), ("very fresh", "Very fresh")]
)
def test_normalised_type(spark, raw, shown):
    assert one(spark, text.normalised_type(F.lit(raw))) == shown
    assert one(spark, text.is_type(F.lit(raw), "Fresh")) == (shown == "Fresh")


def test_clip_words(spark):
    body = F.lit("  one  two\nthree four ")
    assert one(spark, text.clip_words(body, 3)) == "one two three"
    assert one(spark, text.within_words(body, 4)) is True
    assert one(spark, text.within_words(F.lit("a b c d e f g h"), 4)) is False
    assert one(spark, text.clip_words(body, None)) == "  one  two\nthree four "


def test_content_id_matches_hashlib(spark):
    import hashlib

    for prefix, kept in ((None, 90), (80, 80)):
        raw = "m/1|Ann||" + "é" * kept
        made = text.content_id(
            F.lit("m/1"), F.lit("Ann"), F.lit(None).cast("string"), F.lit("é" * 90), prefix
        )
        assert one(spark, made) == hashlib.sha1(raw.encode()).hexdigest()[:20]


def test_byline(spark):
    assert one(spark, text.byline_name(F.lit("by  A. O. Scott "), "NYT")) == "A. O. Scott"
    assert one(spark, text.byline_name(F.lit("By "), "NYT")) == "NYT"
    assert one(spark, text.byline_name(F.lit(None).cast("string"), "NYT")) == "NYT"
    assert one(spark, text.byline_name(F.lit("Bya Lee"), "NYT")) == "Bya Lee"


def test_genre_items_keep_repeats(spark):
    assert one(spark, text.list_items(F.lit("A, B,A"))) == ["A", "B", "A"]


def test_bar_width_rounds_halves_up(spark):
    assert one(spark, scores.bar_width(F.lit(-1.0), F.lit(8.0))) == 13
    assert one(spark, scores.bar_width(F.lit(0.0), F.lit(0.0))) == 0


def test_parse_day(spark):
    assert one(spark, dates.parse_day(F.lit("2020-02-30"))) is None
    assert one(spark, dates.parse_day(F.lit("2020-02-29T10:00:00Z"))) == dt.date(2020, 2, 29)
    assert one(spark, dates.parse_day(F.lit("soon"))) is None


@pytest.mark.parametrize("days, at90, at89", [(89, 1, 1), (90, 1, 0), (91, 0, 0)])
def test_active_flag(spark, days, at90, at89):
    released = F.date_sub(F.lit("2024-06-01").cast("date"), days)
    assert one(spark, dates.active_flag(released, "2024-06-01", 90)) == at90
    assert one(spark, dates.active_flag(released, "2024-06-01", 89)) == at89
    assert one(spark, dates.active_flag(F.lit(None).cast("date"), "2024-06-01", 90)) == 0


@pytest.mark.parametrize(
    "votes, overall",
    [((2, 1, 0), "Positive"), ((1, 2, 0), "Negative"), ((1, 1, 0), "Mixed"),
     ((1, 0, 2), "Mixed"), ((0, 0, 0), "Mixed")],
)
def test_overall_sentiment(spark, votes, overall):
    assert one(spark, aspects.overall_sentiment(*(F.lit(n) for n in votes))) == overall


@pytest.mark.parametrize(
    "fast, deep, expected",
    [
        (("Positive", 0.9), ("Positive", 0.8), ("Positive", 0.85, True, "ensemble")),
        (("Positive", 0.6), ("Negative", 0.9), ("Negative", 0.738, False, "ensemble_disagreement")),
    ],
)
def test_ensemble(spark, fast, deep, expected):
    columns = classify.agreement(*(F.lit(x) for x in (*fast, *deep)))
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    assert tuple(row) == expected


# --- Mann-Kendall ------------------------------------------------------------


def kendall(spark, xs):
    df = spark.createDataFrame([(xs,)], "xs array<double>")
    s = stats.mk_score(F.col("xs"))
    variance = stats.mk_variance(F.col("xs"))
    z = stats.mk_z(s, variance)
    return df.select(
        s, variance, z, stats.mk_tau(s, F.size("xs")), stats.two_sided_p(z), stats.mk_trend(z)
    ).first()


def by_hand(xs):
    import math
    from collections import Counter

    n = len(xs)
    s = sum((b > a) - (b < a) for i, a in enumerate(xs) for b in xs[i + 1:])
    variance = (
        n * (n - 1) * (2 * n + 5)
        - sum(t * (t - 1) * (2 * t + 5) for t in Counter(xs).values())
    ) / 18
    z = 0.0 if s == 0 else (s - math.copysign(1, s)) / math.sqrt(variance)
    return s, variance, z, s / (n * (n - 1) / 2), math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize(
    "xs",
    [
        [0.1, 0.2, 0.3, 0.4, 0.5, 0.6],
        [1.0, 0.5, 0.5, 0.25, 0.0, 0.0, 0.0],
        [0.5, 0.5, 0.5, 0.5, 0.5],
        [0.0, 1.0, 0.0, 1.0, 1.0],
        [float(i % 7) for i in range(40)],
        [float(i) for i in range(60)],
    ],
)
def test_mann_kendall_by_hand(spark, xs):
    s, variance, z, tau, p, trend = kendall(spark, xs)
    es, ev, ez, et, ep = by_hand(xs)
    assert s == es
    assert variance == pytest.approx(ev)
    assert z == pytest.approx(ez)
    assert tau == pytest.approx(et)
    assert p == pytest.approx(ep, rel=1e-9)
    assert trend == ("no trend" if abs(ez) <= 1.96 else "increasing" if ez > 0 else "decreasing")


def test_p_value_over_its_range(spark):
    import math

    zs = [0.0, 0.01, 0.5, 1.0, 1.959963984540054, 3.0, 3.53, 3.54, 5.0, 8.0, 12.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, p in values(df.select("z", stats.two_sided_p(F.col("z")))):
        assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-10)
