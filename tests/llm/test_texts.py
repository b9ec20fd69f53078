"""License scan, quality rules, quality model, packing."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import jaccard, license_scan, packing, quality_model, quality_rules
from gapspark.llm.common import table


def test_phrases_and_blocks(spark, odd, none):
    rows = [
        (1, "The MIT License\nunder the Apache LICENSE, mit license mit license"), (2, "cc-by! CC BY"), (3, "xmit license"), (4, None), (5, ""),
        (6, "Licensed under the Apache License, version 2.0"), (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software"),
        (8, "permission is granted"), (9, "gnu general public\nlicense"), (6, "Licensed under the Apache License, version 2.0"), (None, "mit license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("label", F.lit(1))
    got = sorted(license_scan.license_scan(df).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (4, 1, 9, "apache,mit")
    assert (by[2].n_base, by[2].first_word, by[2].last_word, by[2].score) == (2, 0, 2, 1.0)
    assert (by[3].n_base, by[3].first_word, by[4].n_words, by[5].labels) == (0, None, 0, "")
    assert (by[7].base_labels, by[7].labels, by[8].labels) == ("", "mit", "") and 0.8 <= by[7].score < 1
    assert by[9].n_base == 1 and by[None].base_labels == "mit"
    assert license_scan.license_scan(none).count() == 0 and license_scan.license_scan(odd).count() == 8


def test_every_block_that_holds_a_template_is_found(spark):
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    templates = tuple((f"t{i}", " ".join(random.choice(words, int(n), replace=False))) for i, n in enumerate(random.integers(1, 12, 8)))
    texts = [(i, "\n".join(" ".join(random.choice(words, int(n))) for n in random.integers(0, 40, 6))) for i in range(80)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        hits = license_scan.template_matches(df, "text", ["k"], [F.col("doc_id").alias("k")], templates, threshold)
        got = {(r.k, r.block, r.template) for r in hits.collect()}
        want = {
            (k, b, t) for k, text in texts for b, line in enumerate(text.split("\n")) for t, (_, words_) in enumerate(templates)
            if len(set(line.split()) & set(words_.split())) >= threshold * len(set(words_.split())) - 1e-9
        }
        assert got == want


WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_statistics(text):
    words = WORDS(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_match_brute_force(spark, folder):
    texts = ["", " \n", "a", "a b", "a b c", "a b c a b c", "x\nx\n\n \nx ", "a a a a a", "#*| <>& é ß b", "a b c d a b c\nq\nq"]
    texts += [r.text for r in table(spark, folder, "documents").collect() if len(r.text) < 3000]
    for text in texts:
        assert quality_rules.statistics(text)[:5] == brute_statistics(text), text[:80]


def test_distances_match_a_plain_estimate(spark):
    """One cell: concentration steps in numpy, with the same distance classes."""
    random = np.random.default_rng(2)
    vocabulary = [f"{'abcdefghij'[i % 10] * (i % 7 + 2)}{i}" for i in range(400)]
    rows = []
    for i in range(400):
        words = list(random.choice(vocabulary, int(random.integers(60, 200))))
        rows.append((i, " ".join(w + "." if k % 8 == 7 else w for k, w in enumerate(words)), "en", "s"))
    rows += [(400 + i, " ".join(f"{w.upper()}!!" for w in random.choice(vocabulary, 90)), "en", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    x = np.array([quality_rules.statistics(t)[5] for _, t, _, _ in rows])
    n = np.array([quality_rules.statistics(t)[0] for _, t, _, _ in rows])
    assert all(got[i].kept for i in range(400)) and not any(got[400 + i].kept for i in range(40))
    # the nearest three quarters are junk-free, so their plain moments are near the estimate
    d2 = np.array([got[i].d2 for i in range(len(rows))])
    near = np.argsort(d2)[: int(0.75 * len(rows))]
    assert near.max() < 400
    shrink = (n / (n + quality_rules.SHRINK))[:, None]
    centre = x[near].mean(axis=0)
    scatter = np.cov(((x - centre) * shrink)[near].T, bias=True) * 1.2 + quality_rules.FLOOR
    plain = np.einsum("ij,jk,ik->i", (x - centre) * shrink, np.linalg.inv(scatter), (x - centre) * shrink)
    assert np.corrcoef(np.log(plain), np.log(d2))[0, 1] > 0.95


def test_a_third_of_equal_junk_is_rejected(spark):
    random = np.random.default_rng(6)
    vocabulary = [f"{'abcdefghij'[i % 10] * (i % 7 + 2)}{i}" for i in range(400)]
    rows = []
    for i in range(400):
        words = random.choice(vocabulary, int(random.integers(60, 200)))
        rows.append((i, " ".join(w + "." if k % 8 == 7 else w for k, w in enumerate(words)), "en", "s"))
    junk = " ".join(f"{w.upper()}!!" for w in random.choice(vocabulary, 90))
    rows += [(400 + i, junk, "en", "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k for k, r in got.items() if r.kept} == set(range(400))


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == 8 and {r.kept for r in got if r.base_failed} == {False}
    assert [r.base_failed for r in got if r.doc_id == 5] == [False]
    assert quality_rules.quality_rules(none).count() == 0


def test_chi_square():
    assert quality_rules.chi_square_upper(0.05, 1) == pytest.approx(3.8415, abs=1e-3)
    assert quality_rules.chi_square_upper(0.01, 7) == pytest.approx(18.4753, abs=1e-3)


def test_grades_are_learned(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    ratings = quality_model.graded(table(spark, "/root/testdata/sf0.1", "labels"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(4)) == 0
    model = quality_model.train(docs, ratings.where(~held_out), grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality_model.apply(docs, model).join(ratings.where(held_out), "doc_id")
    kept = {r.grade: r.k for r in scored.groupBy("grade").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[2] > 0.98 and kept[0] < 0.05 and kept[1] < 0.3
    grades = [r.e for r in scored.groupBy("grade").agg(F.avg("expected_grade").alias("e")).orderBy("grade").collect()]
    assert grades == sorted(grades)


def test_model_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (2, None, 0), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality_model.graded(labels).collect()} == {(1, 1), (5, 0)}
    model = quality_model.train(odd, quality_model.graded(labels), grades=3)
    assert quality_model.apply(odd, model).count() == 8
    assert quality_model.train(none, quality_model.graded(labels), grades=3).weights.any() == np.False_
    assert quality_model.apply(none, model).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    random = np.random.default_rng(buckets)
    for _ in range(20):
        lengths = np.sort(random.choice(40, int(random.integers(1, 9)), replace=False)).astype(np.int64)
        counts = random.integers(1, 20, len(lengths)).astype(np.int64)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

        got = packing.optimal_boundaries(lengths, counts, buckets)
        best = min(
            padding([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], k)
        )
        assert padding(got) == best and len(got) <= buckets


def test_batches_hold_every_piece_once(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "SLOT_ROWS", 40)
    rows = [(i % 150, " ".join(["w"] * ((i * 37) % 130))) for i in range(300)] + [(7, "w " * 700)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, max_len=100, buckets=4, budget=400).collect()
    lengths = sorted(len(t.split()) for _, t in rows)
    assert sum(r.n_tokens for r in got) == sum(lengths)
    assert all(r.n_tokens <= r.padded <= 100 for r in got)
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        room = max(1, 400 // max(1, own[0].padded))
        assert sorted((r.batch, r.slot_in_batch) for r in own) == [divmod(i, room) for i in range(len(own))]
    assert packing.pack(none).count() == 0
    assert sum(r.n_tokens for r in packing.pack(odd).collect()) == 30_000 + 4 * 5 + 1


def test_fit_is_the_maximum_of_a_plain_likelihood():
    """The penalised likelihood, written out per row, falls in every direction from the fit."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(300):
        told = np.flatnonzero(rng.random(6) < 0.4)
        score = 1.5 - 2.0 * (0 in told) - 1.0 * (1 in told) + rng.logistic()
        rows.append((told.astype(np.int32), int(score > 0) + int(score > 1)))
    model = quality_model.fit(quality_model.Rated.of(rows), 3, l2=0.1, least_z=1.0)
    used = np.flatnonzero(model.weights)
    assert {0, 1} <= set(used)

    def plain(weights, thresholds):
        total = -0.05 * sum(w * w for w in weights)
        for told, grade in rows:
            score = sum(w for f, w in zip(used, weights, strict=True) if f in told)
            above = [1.0, *(1 / (1 + np.exp(t - score)) for t in thresholds), 0.0]
            total += np.log(above[grade] - above[grade + 1])
        return total

    weights, best = model.weights[used], plain(model.weights[used], model.thresholds)
    for step in np.vstack([np.eye(len(used) + 2), rng.normal(size=(10, len(used) + 2))]) * 0.05:
        for sign in (1, -1):
            assert plain(weights + sign * step[:-2], model.thresholds + sign * step[-2:]) < best + 1e-3


def test_model_columns_give_way_or_stay(spark, odd):
    model = quality_model.OrdinalModel(np.zeros(quality_model.BUCKETS), np.array([-1.0, 0.5]))
    got = quality_model.apply(odd, model, keep=None)
    assert got.columns == [c for c in odd.columns if c != "kept"] + list(quality_model.RESULT)
    free = quality_model.apply(odd, model, keep=None, result=("a", "b", "c"))
    assert free.columns == [*odd.columns, "a", "b", "c"] and {r.kept for r in free.collect()} == {"no"}


def test_a_worker_holds_the_words_of_one_operator(monkeypatch):
    monkeypatch.setattr(quality_model, "MEMO", {})
    text = "Some words, some more WORDS and a 1234567 of them."
    jaccard.begin_task()
    jaccard.shingles(text, 3)
    assert jaccard.CODES
    quality_model.begin_task()
    found = quality_model.features(text)
    assert not jaccard.CODES and set(quality_model.MEMO) == set(text.split())
    want = {b for w in set(text.split()) for b in quality_model.word_features(w)}
    assert want < set(found.tolist()) and len(found) == len(want) + 1 and found.dtype == np.int32
    # a word's buckets take a fraction of a list of numbers
    assert all(isinstance(b, bytes) and len(b) == 4 * len(quality_model.word_features(w)) for w, b in quality_model.MEMO.items())
    jaccard.begin_task()
    assert not quality_model.MEMO
