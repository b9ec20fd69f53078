"""Quality rules: base rules, and robust multivariate outliers per language and source.

Every document gives a vector of transformed statistics. For each cell (language and
source; the language or all documents where a cell has too few rows) the minimum
covariance determinant estimate is found by concentration steps: centre and scatter
of the half of the rows (the greatest breakdown) that lie nearest to the last estimate,
so junk copies may hold nearly half of a cell. A document whose
squared Mahalanobis distance is beyond the cut is rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapspark.llm.common import memo_of_task, stored

WORDS = re.compile(r"[^ \t-\r]+").findall
SYMBOLS = "#*$%&|<>"
#: Names and least standard deviations of the vector's entries. The floor keeps an
#: entry usable that is one value in nearly all rows (the scatter would be singular).
FEATURES = {
    "word_length": 0.08, "symbols": 0.10, "dup_lines": 0.25, "repeats": 0.15, "capitals": 0.10,
    "punctuation": 0.06, "variety": 0.04,
}
P = len(FEATURES)
#: Rows a cell needs for an estimate of its own.
LEAST_ROWS = 40 * P
STEPS = 8
#: Rows on a ratio of few words vary more: deviations shrink by n / (n + this).
SHRINK = 60.0
#: Chi-square tail that sets the cut. With floors in the scatter, clean rows stay far below it.
TAIL = 0.05


def statistics(text: str) -> tuple:
    """Base statistics and the vector of one text."""
    words = WORDS(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORDS(x)] if "\n" in text else words[:1]
    dup_lines = len(lines) - len(set(lines))
    repeats = distinct = 0
    if n:
        code = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        distinct = len(np.unique(code))
        if n > 2:
            mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + code[2:] * np.uint64(0x165667B19E3779F9)
            order = np.argsort(mixed, kind="stable")
            same = mixed[order[1:]] == mixed[order[:-1]]
            if same.any():
                twice = np.zeros(n - 2, dtype=bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                covered = np.zeros(n, dtype=bool)
                for shift in range(3):
                    covered[shift : n - 2 + shift] |= twice
                repeats = int(covered.sum())
    if n:
        turn = lambda share: math.asin(math.sqrt(min(1.0, share)))
        vector = [
            math.log(chars / n), turn(symbols / max(1, chars)), turn(dup_lines / max(1, len(lines))), turn(repeats / n),
            turn(sum(map(str.isupper, words)) / n), turn(sum([w[-1] in ".,!?;:" for w in words]) / n),
            math.log(distinct) / math.log(n) if n > 1 else 1.0,
        ]
    else:
        vector = [0.0] * P
    return n, chars, symbols, dup_lines, repeats, vector


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, vector array<double>"


def document_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, the statistics and the vector, one row per row; no shuffle."""
    from pyspark.sql.types import StructType

    kept = df.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = StructType(kept.schema.fields[:-1] + StructType.fromDDL(STATS).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of_task(None)
        for batch in batches:
            got = [statistics(t) for t in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
            columns.append(pa.array([g[5] for g in got], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + columns, names=schema.names)

    return kept.mapInArrow(run, schema)


def chi_square_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    if z > a + 60:
        return 1.0
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi_square_upper(tail: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi_square_cdf(mid, k) > tail else (low, mid)
    return high


#: Distance classes: 40 to each doubling of the squared distance, 1200 at most.
def distance_class(d2: Column) -> Column:
    return F.least(F.lit(1199), F.greatest(F.lit(0), F.floor((F.log2(d2 + 1e-9) + 10) * 40))).cast("int")


def deviations() -> list[Column]:
    shrink = F.col("n_words") / (F.col("n_words") + SHRINK)
    return [(F.col("vector")[i] - F.col("centre")[i]) * shrink for i in range(P)]


def squared_distance() -> Column:
    """Against the estimate in the row's columns ``centre`` and ``inverse``."""
    d = [F.col(f"__d{i}") for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total += F.col("inverse")[i * P + j] * (d[i] * d[j]) * (1 if i == j else 2)
    return total


def measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with their cell's estimate and ``d2``. Cells are few next to rows; the
    planner broadcasts the estimates when their files are small and joins by key else."""
    joined = rows.join(estimates, "cell", "left")
    joined = joined.withColumns({f"__d{i}": d for i, d in enumerate(deviations())})
    return joined.withColumn("d2", squared_distance())


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOOR = np.diag(np.square(list(FEATURES.values())))


def nearest(total: int) -> int:
    """Rows of a cell that an estimate takes: the share of the greatest breakdown."""
    return min(total, (total + P + 1) // 2)


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: a new estimate per cell.

    Moments are summed by cell and distance class with partial sums before the
    shuffle, so a hot cell sends at most 1200 rows per task, and a cell's classes, never
    its rows, meet in one task.
    """
    have = measured(rows, estimates).withColumn("class", distance_class(F.col("d2")))
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(F.col(f"__d{i}")).alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(f"__d{i}") * F.col(f"__d{j}")).alias(f"q{i}_{j}") for i, j in PAIRS]
    by_class = have.groupBy("cell", "class", "centre").agg(*sums)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("class")
        total = int(group["n"].sum())
        n = float(nearest(total))
        count = group["n"].to_numpy(dtype=float)
        # the class that crosses the share counts with the part that is still missing
        part = np.clip(n - (count.cumsum() - count), 0, count) / count
        mean = part @ group[[f"s{i}" for i in range(P)]].to_numpy() / n
        second = np.zeros((P, P))
        for (i, j), value in zip(PAIRS, part @ group[[f"q{i}_{j}" for i, j in PAIRS]].to_numpy(), strict=True):
            second[i, j] = second[j, i] = value / n
        share = n / total
        cut = chi_square_upper(1 - share, P) if share < 1 else None
        factor = share / chi_square_cdf(cut, P + 2) if cut else 1.0
        scatter = (second - np.outer(mean, mean)) * factor + FLOOR
        centre = np.asarray(group["centre"].iloc[0]) + mean
        return pd.DataFrame([{
            "cell": group["cell"].iloc[0], "centre": centre.tolist(),
            "inverse": np.linalg.inv(scatter).ravel().tolist(), "log_det": float(np.linalg.slogdet(scatter)[1]),
        }])

    solved = by_class.groupBy("cell").applyInPandas(
        solve, "cell string, centre array<double>, inverse array<double>, log_det double"
    )
    return stored(solved, "mcd-estimate")


def first_estimates(rows: DataFrame) -> DataFrame:
    """Medians, and the floors and median deviations as scatter without correlation."""
    middle = stored(rows.groupBy("cell").agg(
        F.array(*[F.percentile_approx(F.col("vector")[i], 0.5, 10000) for i in range(P)]).alias("centre"),
    ), "mcd-medians")
    off = [F.abs(F.col("vector")[i] - F.col("centre")[i]) for i in range(P)]
    middle = rows.join(middle, "cell").groupBy("cell", "centre").agg(
        F.array(*[F.percentile_approx(d, 0.5, 10000) for d in off]).alias("off")
    )
    spread = [F.col("off")[i] * 1.4826 for i in range(P)]
    inverse = [
        1 / (spread[i] * spread[i] + F.lit(float(FLOOR[i, i]))) if i == j else F.lit(0.0)
        for i in range(P) for j in range(P)
    ]
    return stored(middle.select("cell", "centre", F.array(*inverse).alias("inverse"), F.lit(0.0).alias("log_det")), "mcd-start")


def with_cells(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """The cell whose estimate judges a row: language and source if it has enough rows,
    else the language, else all; ``feeds`` are the cells whose estimate it is part of.
    Null languages and sources are values of their own."""
    a, b = F.coalesce(F.col(lang), F.lit("\x00")), F.coalesce(F.col(source), F.lit("\x00"))
    keyed = rows.withColumns({"__a": a, "__b": b})
    sizes = stored(keyed.where("fit").groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n")), "cell-sizes")
    langs = stored(sizes.groupBy("__a").agg(F.sum("__n").alias("__m"), F.min("__n").alias("__least")), "language-sizes")
    least = langs.agg(F.min("__m")).first()[0]
    pooled = least is not None and least < LEAST_ROWS
    of_source, of_lang = F.concat_ws("\x01", F.lit("s"), "__a", "__b"), F.concat_ws("\x01", F.lit("l"), "__a")
    own, shared = F.col("__n") >= LEAST_ROWS, F.col("__m") >= LEAST_ROWS
    cell = F.when(own, of_source).when(shared, of_lang).otherwise(F.lit("all"))
    feeds = F.array(
        F.when(own, of_source), F.when(shared & (F.col("__least") < LEAST_ROWS), of_lang), F.lit("all" if pooled else None)
    )
    cells = stored(sizes.join(langs, "__a").select("__a", "__b", cell.alias("cell"), F.array_compact(feeds).alias("feeds")), "cells")
    known = keyed.join(cells, ["__a", "__b"], "left").withColumn("cell", F.coalesce("cell", F.lit("all")))
    return known.drop("__a", "__b")


def quality_rules(
    df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source",
    min_words: int = 50, max_repeat: int = 50, tail: float = TAIL,
) -> DataFrame:
    """One row per document: key, statistics, base_failed, distance, kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of
    the words in repeated 3-word windows. Documents that pass are judged by distance;
    ``d2`` is null for the others. Null and empty texts have no words and fail. Rows
    with the same key are separate documents. A cell takes part in an estimate with all
    rows that pass the base rules; when no row passes, nothing is estimated. An empty
    table gives no row. Columns that are not named are not read.
    """
    names = list(dict.fromkeys([key, lang, source]))
    stats = document_statistics(df, text, tuple(names))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    stats = stats.select(
        F.col(f"`{key}`").alias("__key"), F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "vector",
        failed.alias("base_failed"), (~failed).alias("fit"),
    )
    rows = with_cells(stored(stats, "quality-statistics"), "__lang", "__source")
    fit = rows.where("fit").select(F.explode("feeds").alias("cell"), "n_words", "vector")
    estimates = first_estimates(fit)
    before = None
    for _ in range(STEPS):
        estimates = concentrate(fit, estimates)
        now = estimates.agg(F.sum("log_det"), F.max("log_det")).first()
        if before is not None and now[0] is not None and abs(now[0] - before) < 1e-3 * max(1.0, abs(before)):
            break
        before = now[0]
        if before is None:
            break
    cut = chi_square_upper(tail, P)
    judged = measured(rows, estimates)
    d2 = F.when(F.col("fit"), F.col("d2"))
    return judged.select(
        F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        d2.alias("d2"), (F.col("fit") & (F.coalesce(d2, F.lit(0.0)) <= cut)).alias("kept"),
    )
