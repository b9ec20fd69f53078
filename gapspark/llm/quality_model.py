"""Ordinal cumulative-link regression on hashed text: expected grade and tails.

P(grade > k) = sigmoid(score - threshold_k) with one weight vector for all grades and
ordered thresholds. The score is the sum of the weights of the hashed features that
occur in a text: its words in lower case, their beginnings, and word shapes. Only
features that tell against a text get a weight, so that much ordinary text does not
outweigh one word that tells.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from gapspark.llm.common import memo_of_task, open_fs
from gapspark.session import fresh_path

WORDS = re.compile(r"[^ \t-\r]+").findall
BUCKETS = 1 << 18
#: Labelled rows a fit uses at most: the first by a hash of the key.
MAX_FIT = 10_000
MEMO_SIZE = 300_000
EDGES = ".,;:!?\"'()[]"


def word_features(word: str) -> list[int]:
    """Buckets of one word: its shape, the word without edge marks, its beginnings."""
    core = word.strip(EDGES).lower()
    shape = "".join(dict.fromkeys(
        "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word
    ))
    names = [f"s={shape}", f"u={word.isupper() and len(word) > 1}"]
    if core:
        names.append(f"w={core}")
        names += [f"p={core[:k]}" for k in range(3, min(8, len(core)))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


#: Buckets by word, as the bytes of 32-bit numbers: a third of what lists of numbers take.
MEMO: dict[str, bytes] = {}


def begin_task() -> None:
    memo_of_task(MEMO)


def features(text: str) -> np.ndarray:
    """Distinct buckets of a text, ascending.

    Besides its words: whether words repeat much, for texts that say one word often.
    """
    words = WORDS(text)
    distinct = set(words)
    out: list[bytes] = []
    for w in distinct:
        got = MEMO.get(w)
        if got is None:
            got = array("i", word_features(w)).tobytes()
            if len(MEMO) < MEMO_SIZE:
                MEMO[w] = got
        out.append(got)
    if words:
        # how far the vocabulary is below what a text of this length mostly has
        v = zlib.crc32(b"v=%d" % int(10 * np.log(len(distinct) + 1) / np.log(len(words) + 1))) % BUCKETS
        out.append(array("i", [v]).tobytes())
    return np.unique(np.frombuffer(b"".join(out), dtype=np.int32))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, score):
        """P(grade > k) for each k, in the last axis."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(score)[..., None] - self.thresholds, -40, 40)))


@dataclass
class Rated:
    """Rated texts: the buckets of all rows end to end, where each row ends, its grade."""

    buckets: np.ndarray
    ends: np.ndarray
    grade: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, int]]) -> Rated:
        ends = np.cumsum([0, *[len(b) for b, _ in rows]])
        buckets = np.concatenate([b for b, _ in rows]) if rows else np.zeros(0, np.int32)
        return cls(buckets.astype(np.int32), ends, np.array([g for _, g in rows], np.int64))

    def __len__(self) -> int:
        return len(self.grade)

    def parts(self, size: int):
        """Rows in parts: the rows' numbers, their buckets, the row of each bucket."""
        for at in range(0, len(self), size):
            edges = self.ends[at : at + size + 1]
            rows = np.arange(at, at + len(edges) - 1)
            yield rows, self.buckets[edges[0] : edges[-1]], np.repeat(rows, np.diff(edges))


def screen(rows: Rated, above: np.ndarray, least_rows: int, least_z: float, most: int) -> np.ndarray:
    """The ``most`` features that a score test of the model without weights holds
    against a text with at least ``least_z`` standard errors, ascending."""
    tail = np.concatenate([[1.0], above, [0.0]])
    slope = tail * (1 - tail)
    of_grade = (slope[:-1] - slope[1:]) / np.maximum(tail[:-1] - tail[1:], 1e-12)
    n, total, square, marks = (np.zeros(BUCKETS) for _ in range(4))
    # features of just the same rows (a word and its beginnings) count once
    mark = np.random.default_rng(3).random(len(rows))
    for _, flat, owner in rows.parts(500):
        value = of_grade[rows.grade[owner]]
        n += np.bincount(flat, minlength=BUCKETS)
        total += np.bincount(flat, value, minlength=BUCKETS)
        square += np.bincount(flat, value * value, minlength=BUCKETS)
        marks += np.bincount(flat, mark[owner], minlength=BUCKETS)
    z = -total / np.sqrt(square + 1e-12)
    z[n < least_rows] = 0
    best = np.argsort(-z, kind="stable")
    best = best[z[best] >= least_z]
    marks = np.round(marks[best], 9)
    _, first = np.unique(marks, return_index=True)
    return np.sort(best[np.sort(first)][:most])


class Told:
    """Which of the screened features each row has: a sparse matrix of ones."""

    def __init__(self, rows: Rated, features: np.ndarray):
        self.n, self.k = len(rows), len(features)
        place = np.full(BUCKETS, -1, np.int32)
        place[features] = np.arange(self.k)
        found = [(place[flat], owner) for _, flat, owner in rows.parts(500)]
        self.column = np.concatenate([c[c >= 0] for c, _ in found])
        self.row = np.concatenate([o[c >= 0].astype(np.int32) for c, o in found])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], minlength=self.n)

    def across(self, values: np.ndarray) -> np.ndarray:
        """The transposed matrix times values, one or several per row."""
        if values.ndim == 1:
            return np.bincount(self.column, values[self.row], minlength=self.k)
        return np.stack([self.across(v) for v in values.T], axis=1)

    def curvature(self, own: np.ndarray, size: int = 1000) -> np.ndarray:
        """The sum over rows of own times the row's outer product, in dense parts."""
        out = np.zeros((self.k, self.k))
        edges = np.searchsorted(self.row, np.arange(0, self.n + size, size))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            part = np.zeros((min(size, self.n - i * size), self.k), np.float32)
            part[self.row[a:b] - i * size, self.column[a:b]] = 1
            out += part.T @ (part * own[i * size : (i + 1) * size, None].astype(np.float32))
        return out


def likelihood(score: np.ndarray, thresholds: np.ndarray, grade: np.ndarray):
    """Per row the log-likelihood, and its first and second derivatives to
    a = score - (threshold below the grade) and b = score - (threshold above it)."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    a, b = score - edges[grade], score - edges[grade + 1]
    up, down = 1 / (1 + np.exp(-np.clip(a, -40, 40))), 1 / (1 + np.exp(-np.clip(b, -40, 40)))
    up, down = np.where(grade == 0, 1.0, up), np.where(grade == len(thresholds), 0.0, down)
    p = np.maximum(up - down, 1e-12)
    sa, sb = up * (1 - up), down * (1 - down)
    da, db = sa / p, -sb / p
    return np.log(p), da, db, sa * (1 - 2 * up) / p - da * da, -sb * (1 - 2 * down) / p - db * db, sa * sb / (p * p)


def fit(
    rows: Rated, grades: int, l2: float = 0.03, least_rows: int = 4, least_z: float = 3.0,
    most: int = 1500, steps: int = 40,
) -> OrdinalModel:
    """Newton's method on the log-likelihood with an ``l2`` penalty over the screened
    features; it is concave in weights and thresholds together, and the halved steps
    keep the thresholds in order.

    With no rows, or rows of a single grade, the thresholds alone say the shares seen.
    """
    share = np.bincount(rows.grade, minlength=grades) + 0.5 if len(rows) else np.ones(grades)
    above = 1 - np.cumsum(share / share.sum())[:-1]
    start = -np.log(above / (1 - above))
    weights = np.zeros(BUCKETS)
    told = screen(rows, above, least_rows, least_z, most) if len(np.unique(rows.grade)) > 1 else np.zeros(0, int)
    if not len(told):
        return OrdinalModel(weights, start)
    grade, x = rows.grade, Told(rows, told)
    k, t = len(told), grades - 1
    # column c of these says whether a (b) holds threshold c
    holds_a, holds_b = (grade[:, None] - 1 == np.arange(t)).astype(float), (grade[:, None] == np.arange(t)).astype(float)
    value = np.concatenate([np.zeros(k), start])

    def total(v: np.ndarray) -> float:
        if (np.diff(v[k:]) <= 1e-6).any():
            return -np.inf
        return float(likelihood(x.times(v[:k]), v[k:], grade)[0].sum() - l2 / 2 * (v[:k] ** 2).sum())

    now = total(value)
    for _ in range(steps):
        _, da, db, haa, hbb, hab = likelihood(x.times(value[:k]), value[k:], grade)
        slope = np.concatenate([x.across(da + db) - l2 * value[:k], -(holds_a.T @ da + holds_b.T @ db)])
        curve = np.empty((k + t, k + t))
        curve[:k, :k] = x.curvature(haa + hbb + 2 * hab)
        cross = -x.across(holds_a * (haa + hab)[:, None] + holds_b * (hbb + hab)[:, None])
        curve[:k, k:], curve[k:, :k] = cross, cross.T
        mixed = holds_a.T @ (holds_b * hab[:, None])
        curve[k:, k:] = holds_a.T @ (holds_a * haa[:, None]) + holds_b.T @ (holds_b * hbb[:, None]) + mixed + mixed.T
        curve[np.arange(k), np.arange(k)] -= l2
        curve[np.arange(k, k + t), np.arange(k, k + t)] -= 1e-6
        step, size = np.linalg.solve(-curve, slope), 1.0
        while size > 1e-4 and total(value + size * step) < now:
            size /= 2
        if size <= 1e-4:
            break
        value = value + size * step
        before, now = now, total(value)
        if now - before < 1e-4 * len(rows) ** 0.5:
            break
    weights[told] = value[:k]
    return OrdinalModel(weights, value[k:])


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from two flags: 0 bad, 1 good but toxic, 2 good; repeated keys take the
    lowest, null flags are no rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return rated.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, grades: int, text: str = "text", key: str = "doc_id", max_fit: int = MAX_FIT, **options) -> OrdinalModel:
    """Fit on at most ``max_fit`` rated documents, chosen by a hash of their key.

    ``ratings`` has the key and ``grade`` (0 to grades - 1). The keys are chosen first;
    the texts of those alone are read into the driver, as hashed features.
    """
    chosen = ratings.orderBy(F.xxhash64(F.lit(11), key), key).limit(max_fit)
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).where(F.col(key).isNotNull())
    texts = rows.join(F.broadcast(chosen), key)  # max_fit rows of two numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            got = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["grade", "buckets"]
            )

    hashed = texts.select(F.col("grade").cast("int").alias("grade"), "__text")
    found = hashed.mapInArrow(run, "grade int, buckets array<int>").orderBy(F.xxhash64("grade", "buckets")).limit(max_fit)
    return fit(read_rated(found), grades, **options)


def read_rated(found: DataFrame) -> Rated:
    """Rows of (grade, buckets), bounded by the caller, without a detour over rows of the
    driver's JVM: written once and read as flat arrays."""
    path = fresh_path(found.sparkSession, "rated")
    found.write.parquet(path)
    system, folder = open_fs(path)
    grades, buckets, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for batch in dataset(folder, filesystem=system, format="parquet").to_batches(columns=["grade", "buckets"], batch_size=1000):
        grades.append(batch.column(0).to_numpy().astype(np.int64))
        column = batch.column(1)
        sizes.append(np.diff(column.offsets.to_numpy()))
        buckets.append(column.flatten().to_numpy())
    return Rated(np.concatenate(buckets), np.cumsum(np.concatenate(sizes)), np.concatenate(grades))


RESULT = ("expected_grade", "top_tail", "kept")


def apply(
    df: DataFrame, model: OrdinalModel, text: str = "text", keep: tuple[str, ...] | None = ("doc_id",), least: float = 0.5,
    result: tuple[str, str, str] = RESULT,
) -> DataFrame:
    """One row per row: the ``keep`` columns (None: all), expected_grade, top_tail, kept.

    ``result`` names the three; a kept column of such a name gives way to it.
    ``top_tail`` is P(highest grade); ``kept`` says it is at least ``least``. Null texts
    count as empty, and an empty text has no features: the thresholds alone decide.
    Whole texts are read, row by row, without a shuffle.
    """
    names = df.columns if keep is None else list(keep)
    plain = [F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(names)]
    kept = df.select(*plain, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kinds = (DoubleType(), DoubleType(), BooleanType())
    schema = StructType([*kept.schema.fields[:-1], *(StructField(f"r{i}", t) for i, t in enumerate(kinds))])
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        weights, thresholds = shared.value
        local = OrdinalModel(weights, thresholds)
        for batch in batches:
            scores = np.array([local.score(features(t)) for t in batch.column(len(names)).to_pylist()])
            tails = local.tails(scores)
            added = [pa.array(tails.sum(axis=-1)), pa.array(tails[..., -1]), pa.array(tails[..., -1] >= least)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], *added], names=schema.names)

    judged = kept.mapInArrow(run, schema)
    taken = {name.lower() for name in result}
    own = [F.col(f"c{i}").alias(k) for i, k in enumerate(names) if k.lower() not in taken]
    return judged.select(*own, *(F.col(f"r{i}").alias(name) for i, name in enumerate(result)))
