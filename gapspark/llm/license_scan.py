"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line of a text. It matches a template when it holds at least
``threshold`` of the template's distinct words. Words are ordered by how many blocks
hold them, rarest first. A match must share one of the first
size - needed + 1 words of the template (prefix), hold ``needed`` of its words (length),
and still have room for the rest after the shared word (position). All of it is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm.common import lower_ascii

#: Phrases that the base scan looks for, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Sentences of public licences, in lower-case words, with their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced"),
)

THRESHOLD = 0.8
#: Java's form of the characters that separate words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """Words in lower case, one space between, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), GAPS, " ")), F.lit(" "))


def needed(size: int, threshold: float) -> int:
    """Least whole number of shared words that is ``threshold`` of ``size``."""
    return max(1, -int(-(round(size * threshold * 1e9)) // int(1e9)))


def phrase_places(spaced_text: str, phrases: dict[str, str]) -> Column:
    """Array of (start, label), phrase by phrase. The array of words is only walked for
    phrases that a substring search has found in the row."""
    none = F.expr("CAST(array() AS array<struct<start: bigint, label: string>>)")
    words = F.col("__words")

    def places(phrase: str, label: str) -> Column:
        size = phrase.count(" ") + 1
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i + 1, size), " ") == phrase
        )
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    found = [
        F.when(F.contains(F.col(spaced_text), F.lit(f" {phrase} ")), places(phrase, label)).otherwise(none)
        for phrase, label in phrases.items()
    ]
    return F.flatten(F.array(*found))


def phrase_scan(df: DataFrame, text: str, keep: list[Column], phrases: dict[str, str]) -> DataFrame:
    """The ``keep`` columns, n_words, places (start and label of every phrase); row-local."""
    words = F.split(F.substring(F.col("__spaced"), 2, 2147483647), " ")
    empty = F.col("__spaced") == "  "
    base = df.select(*keep, spaced(F.col(f"`{text}`")).alias("__spaced"))
    anywhere = None
    for phrase in phrases:
        hit = F.contains(F.col("__spaced"), F.lit(f" {phrase} "))
        anywhere = hit if anywhere is None else anywhere | hit
    n = F.when(empty, 0).otherwise(F.length("__spaced") - F.length(F.translate(F.col("__spaced"), " ", "")) - 1)
    base = base.withColumn("n_words", n.cast("long")).withColumn("__words", F.when(anywhere, words))
    return base.withColumn("places", phrase_places("__spaced", phrases)).drop("__spaced", "__words")


def blocks(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """One row per line that has a word: the ``keep`` columns, block number, words once each."""
    lines = df.select(*keep, F.posexplode(F.split(lower_ascii(F.col(f"`{text}`")), "\n", -1)).alias("block", "line"))
    words = F.array_remove(F.array_distinct(F.split(F.regexp_replace("line", GAPS, " "), " ")), "")
    return lines.withColumn("words", words).drop("line")


def template_matches(df: DataFrame, text: str, keep: list[str], keep_columns: list[Column], templates, threshold: float) -> DataFrame:
    """Every (row, block, template) with shared >= needed: ``keep``, block, label, share."""
    spark: SparkSession = df.sparkSession
    sets = [(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(templates)]
    vocabulary = sorted({w for _, _, s in sets for w in s})
    least = min(needed(len(s), threshold) for _, _, s in sets)
    known = F.array(*map(F.lit, vocabulary))
    # words outside the templates can never be shared; the set's size plays no part in containment
    cut = blocks(df, text, keep_columns).withColumn("words", F.array_intersect("words", known))
    held = cut.where(F.size("words") > 0)
    # the global order: by the blocks that hold a word; the vocabulary bounds its size
    seen = dict(held.select(F.explode("words").alias("word")).groupBy("word").count().collect())
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rows = []
    for i, label, words in sets:
        ranks = sorted(order[w] for w in words)
        must = needed(len(ranks), threshold)
        rows += [(i, label, ranks, must, rank, at) for at, rank in enumerate(ranks[: len(ranks) - must + 1])]
    prefixes = spark.createDataFrame(rows, "template int, label string, ranks array<int>, must int, rank int, at int")
    ranked = F.create_map(*[x for w, r in order.items() for x in (F.lit(w), F.lit(r))])
    sorted_ranks = F.array_sort(F.transform("words", lambda w: F.try_element_at(ranked, w)))
    probes = held.where(F.size("words") >= least).withColumn("own", sorted_ranks).drop("words")
    probes = probes.select("*", F.posexplode("own").alias("own_at", "rank"))
    joined = probes.join(F.broadcast(prefixes), "rank")  # one row per word of a fixed list
    # length, and room behind the shared word on either side
    possible = (F.size("own") >= F.col("must")) & (
        F.least(F.size("own") - F.col("own_at"), F.size("ranks") - F.col("at")) + F.least("own_at", "at") >= F.col("must")
    )
    shared = F.size(F.array_intersect("own", "ranks"))
    verified = joined.where(possible).where(shared >= F.col("must"))
    return verified.select(*keep, "block", "template", "label", (shared / F.size("ranks")).alias("share")).distinct()


def license_scan(
    df: DataFrame, text: str = "text", key: str = "doc_id", phrases: dict[str, str] | None = None,
    templates=TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row: key, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_blocks.

    ``score`` is 1 with a phrase, else the largest share of a template that a block holds,
    else 0; ``n_blocks`` counts the blocks that match. Null and empty texts have no words
    and no label. Rows that are equal in key and text (nulls too) have equal results and
    stay apart. Long texts are read whole; an empty table gives no row.
    """
    phrases = PHRASES if phrases is None else phrases
    # equal texts give equal matches, so key and text hash name a row well enough
    keep = [F.col(f"`{key}`").alias("__key"), F.xxhash64(F.col(f"`{text}`")).alias("__hash")]
    base = phrase_scan(df, text, keep, phrases)
    hits = template_matches(df, text, ["__key", "__hash"], keep, templates, threshold)
    by_row = hits.groupBy(F.col("__key").alias("__k"), F.col("__hash").alias("__h")).agg(
        F.collect_set("label").alias("__more"), F.max("share").alias("__share"), F.countDistinct("block").alias("__blocks")
    )
    joined = base.join(by_row, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__hash") == F.col("__h")), "left")
    labels = F.array_sort(F.array_distinct(F.col("places.label")))
    more = F.coalesce("__more", F.expr("CAST(array() AS array<string>)"))
    return joined.select(
        F.col("__key").alias(key), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, more)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))).alias("score"),
        F.coalesce("__blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def oracle() -> str:
    """The same in DuckDB: places of phrases by word lists, containment by brute force."""
    gaps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"({i}, '{label}', {sorted(set(words.split()))!r}, {needed(len(set(words.split())), THRESHOLD)})"
        for i, (label, words) in enumerate(TEMPLATES)
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split(regexp_replace(t, '{gaps}', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM d),
p(words, label) AS (VALUES {phrases}),
places AS (
  SELECT r, i AS start, label FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM w WHERE t LIKE '%license%' OR t LIKE '%cc%by%') x
  JOIN p ON ws[i + 1 : i + len(p.words)] = p.words),
base AS (SELECT r, count(*) AS n, min(start) AS a, max(start) AS b, list_sort(list_distinct(list(label))) AS ls FROM places GROUP BY r),
tpl(id, label, words, must) AS (VALUES {templates}),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS block FROM w),
bw AS (SELECT r, block, list_distinct(list_filter(string_split(regexp_replace(line, '{gaps}', ' ', 'g'), ' '), lambda x: x <> '')) AS ws FROM lines),
hits AS (SELECT r, block, label, len(list_intersect(ws, words))::DOUBLE / len(words) AS share
  FROM bw, tpl WHERE len(list_intersect(ws, words)) >= must),
by_row AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share, count(DISTINCT block) AS nb FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(coalesce(ls, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(more, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, coalesce(nb, 0)::BIGINT AS n_blocks
FROM w LEFT JOIN base USING (r) LEFT JOIN by_row USING (r)"""
