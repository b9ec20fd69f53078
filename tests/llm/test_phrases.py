"""Phrase collocations against counts in plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gapspark.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, share, most):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        frequent = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        found = []
        for p, a in frequent.items():
            longer = [f for q, f in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f >= share * a for f in longer):
                continue
            score, cut = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize("sample, sample_least", [(1, 1), (3, 2), (1000, 50)])
def test_equal_to_plain_counts_whatever_the_sample(spark, folder, sample, sample_least):
    """A bad sample only leads to more passes."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute(docs.select("lang", "text").collect(), 8, 50, 60)
    assert mined(docs, least=8, most=60, sample=sample, sample_least=sample_least) == want


def test_odd_rows(spark, odd, none):
    rows = odd.select("lang", "text").collect()
    assert mined(odd, least=2) == brute(rows, 2, 50, 2000)
    assert mined(none) == []


def test_pieces_ties_and_overlaps(spark):
    texts = ["a b a b a b", "A B, a b c. a b c", "x y\tz!x y z", "x y z", None, "", "word" * 50_000]
    df = spark.createDataFrame([(i, t, None if i % 2 else "und") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = df.select("lang", "text").collect()
    for most in (1, 3, 100):
        assert mined(df, least=2, most=most) == brute(rows, 2, 50, most)


def test_tasks_that_fill_up_hand_on_partial_counts(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang = 'de'").select("lang", F.col("text").cast("binary").alias("text"))
    rule = phrases.Pass(longest=2)
    texts = [r.text for r in docs.collect()]
    whole, parts = phrases.Counter("de", rule), phrases.Counter("de", rule)
    whole.add(texts)
    monkeypatch.setattr(phrases, "PENDING", 500)

    def told(batches):
        out = Counter()
        for b in batches:
            for k, p, f in zip(b.column("k").to_pylist(), b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True):
                out[k, p] += f
        return out

    want = told(whole.rows())
    got = Counter()
    for text in texts:
        parts.add([text])
        got += told(parts.rows())
    assert got == want


def test_products_beyond_64_bits(spark):
    big = 3 * 10**9
    counts = spark.createDataFrame([("en", 1, "a", big + 7), ("en", 1, "b", big + 1)], "lang string, k int, phrase string, f long")
    row = phrases.cuts(spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a long"), counts).first()
    assert (row.l, row.r, row.score) == (big + 7, big + 1, 10**6 * big * big // ((big + 7) * (big + 1)))


def test_two_word_phrases_only(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert all(len(r[2].split(" ")) == 2 for r in mined(docs, least=8, longest=2))
    with pytest.raises(ValueError):
        phrases.collocations(docs, longest=4)
