"""Phrase collocations by Toivonen's method: a sample proposes, full passes verify.

A sample of documents proposes words and phrases at a lowered threshold. A pass over all
documents counts the proposed phrases and their negative border exactly: the phrases that
were not proposed although all their shorter parts were. Every word is proposed or in the
border, so all words are counted; a pair when both words are proposed, a triple when both
of its pairs are. Border phrases that turn out frequent are failures of the sample: what
they make possible is counted by a further pass, until a pass finds none. All counts of
what is returned are exact and cover every document.

What is proposed or found frequent reaches the tasks as bit maps of a fixed size, by a
checksum of the phrase. Two phrases on one bit only make a task count a phrase that need
not be counted. Tasks count in dictionaries of bounded size and hand on partial counts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import stored

#: Bits of a map of phrases (8 MB), and the factors that join the sums of two words.
BITS, LEFT, RIGHT = 1 << 26, 1_000_003, 769
#: The share of documents in the sample (one in so many), and its threshold.
SAMPLE, SAMPLE_LEAST = 16, 2
#: Per language and task: distinct phrases held, words held, bytes of their texts.
MOST_PHRASES, MOST_WORDS, MOST_BYTES = 3_000_000, 1 << 20, 64 << 20
CHUNK_BYTES, PENDING = 4 << 20, 4_000_000
WORD_BITS = 21
LONGEST = 3
#: Bytes of a UTF-8 text: A-Z in lower case, marks that end a piece as 0xFF, which no text holds.
END = b"\xff"
TO_PIECES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


# --- maps of phrases ---------------------------------------------------------


def word_sum(lang: str, word: bytes) -> int:
    return zlib.crc32(lang.encode() + b"\n" + word)


def place_of(words: list[Column]) -> Column:
    """The bit of a word or a pair, from its words' checksums."""
    if len(words) == 1:
        return words[0] % BITS
    return (words[0] * LEFT + words[1] * RIGHT) % BITS


def bit_map(phrases: DataFrame, k: int) -> np.ndarray:
    """One bit per frequent phrase of k words; BITS / 8 bytes reach the driver at most."""
    parts = F.split("phrase", " ")
    sums = [F.crc32(F.concat("lang", F.lit("\n"), parts[i]).cast("binary")) for i in range(k)]
    place = place_of(sums) + 1
    rows = (
        phrases.where(F.col("k") == k)
        .select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    )
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows.toLocalIterator():
        got = np.frombuffer(bytes(bits), np.uint8)
        out[(bucket - 1) * len(got) : bucket * len(got)] = got
    return out


def holds(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class Pass:
    """What a pass counts. ``words`` and ``pairs`` are maps of the parts that are allowed
    (None: all), and of those that earlier passes allowed, which are counted already."""

    words: np.ndarray | None = None
    pairs: np.ndarray | None = None
    words_before: tuple = ()
    pairs_before: tuple = ()
    longest: int = LONGEST

    @property
    def first(self) -> bool:
        return not self.words_before


# --- counting in a task ------------------------------------------------------


@dataclass
class Counter:
    """Exact counts of one language in a task, on word numbers of its own."""

    lang: str
    rule: Pass
    numbers: dict = field(default_factory=dict)
    sums: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    flags: list = field(default_factory=list)
    ones: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    total: int = 0
    text_bytes: int = 0

    def __post_init__(self) -> None:
        self.numbers = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]
        maps = [self.rule.words, *self.rule.words_before]
        self.flags = [np.zeros(1, bool) for _ in maps]
        self.pending, self.held = {2: [], 3: []}, {2: None, 3: None}

    def add(self, texts: list[bytes]) -> None:
        """Count documents; the end mark between them keeps phrases inside pieces."""
        joined = END.join(texts).translate(TO_PIECES) + END
        words = joined.replace(END, b" \xff ").split()
        known = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self._learn(known)
        counts = np.bincount(ids, minlength=len(self.numbers))
        counts[0] = 0
        counts[: len(self.ones)] += self.ones
        self.ones = counts
        self.total += int((ids > 0).sum())
        self._pairs_and_triples(ids)

    def _learn(self, known: int) -> None:
        fresh = list(islice(self.numbers, known, None))
        sums = np.array([word_sum(self.lang, w) for w in fresh], np.int64)
        self.text_bytes += sum(map(len, fresh))
        self.sums = np.concatenate([self.sums, sums])
        maps = [self.rule.words, *self.rule.words_before]
        for i, bits in enumerate(maps):
            told = np.ones(len(fresh), bool) if bits is None else holds(bits, sums % BITS)
            self.flags[i] = np.concatenate([self.flags[i], told])

    def _pairs_and_triples(self, ids: np.ndarray) -> None:
        left, right = ids[:-1], ids[1:]
        real = (left > 0) & (right > 0)
        told = [f[left] & f[right] for f in self.flags]
        wanted = real & told[0]
        for before in told[1:]:
            wanted &= ~before
        self._hold(2, left[wanted] << WORD_BITS | right[wanted])
        if self.rule.longest < 3 or self.rule.pairs is None:
            return
        at = np.flatnonzero(real)
        place = (self.sums[left[at]] * LEFT + self.sums[right[at]] * RIGHT) % BITS
        both = []
        for bits in (self.rule.pairs, *self.rule.pairs_before):
            inside = np.zeros(len(real), bool)
            inside[at] = holds(bits, place)
            both.append(inside[:-1] & inside[1:])
        wanted = both[0]
        for before in both[1:]:
            wanted &= ~before
        at = np.flatnonzero(wanted)
        self._hold(3, (ids[at] << WORD_BITS | ids[at + 1]) << WORD_BITS | ids[at + 2])

    def _hold(self, k: int, codes: np.ndarray) -> None:
        if len(codes):
            self.pending[k].append(codes)
        if sum(map(len, self.pending[k])) > PENDING:
            self._settle(k)

    def _settle(self, k: int) -> None:
        codes = [*self.pending[k]]
        self.pending[k] = []
        if not codes:
            return
        codes, counts = np.unique(np.concatenate(codes), return_counts=True)
        if self.held[k] is not None:
            codes = np.concatenate([self.held[k][0], codes])
            counts = np.concatenate([self.held[k][1], counts])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], counts[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            codes, counts = codes[starts], np.add.reduceat(counts, starts)
        self.held[k] = (codes, counts)

    @property
    def full(self) -> bool:
        held = sum(len(h[0]) for h in self.held.values() if h is not None)
        return held > MOST_PHRASES or len(self.numbers) > MOST_WORDS or self.text_bytes > MOST_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(lang, k, phrase, f); k = 0 holds the number of words. Starts afresh behind it."""
        words = pa.array(self.numbers, pa.binary())
        if self.rule.first:
            yield self._batch(0, pa.array([b""], pa.binary()), np.array([self.total]))
            told = np.flatnonzero(self.ones)
            for at in range(0, len(told), 50_000):
                part = told[at : at + 50_000]
                yield self._batch(1, words.take(pa.array(part)), self.ones[part])
        for k in (2, 3):
            self._settle(k)
            if self.held[k] is None:
                continue
            codes, counts = self.held[k]
            for at in range(0, len(codes), 50_000):
                part = codes[at : at + 50_000]
                mask = (1 << WORD_BITS) - 1
                numbers = [(part >> (WORD_BITS * (k - 1 - i))) & mask for i in range(k)]
                texts = pc.binary_join_element_wise(*(words.take(pa.array(n)) for n in numbers), b" ")
                yield self._batch(k, texts, counts[at : at + 50_000])
        lang, rule = self.lang, self.rule
        self.__init__(lang, rule)

    def _batch(self, k: int, texts: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([self.lang] * len(texts)), pa.array(np.full(len(texts), k, np.int32)),
                   texts.cast(pa.string()), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "f"])


def partial_counts(docs: DataFrame, rule: Pass) -> DataFrame:
    """(lang, k, phrase, f) per task; ``docs`` is (lang, text) with the text as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(rule)  # maps of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in by_language(batch):
                if lang not in counters:
                    counters[lang] = Counter(lang, shared.value)
                counters[lang].add(texts)
                if counters[lang].full:
                    yield from counters[lang].rows()
            # many small languages are bounded together, too
            if sum(len(c.numbers) for c in counters.values()) > 2 * MOST_WORDS:
                for lang in list(counters):
                    yield from counters.pop(lang).rows()
        for counter in counters.values():
            yield from counter.rows()

    return docs.mapInArrow(run, "lang string, k int, phrase string, f long")


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language in pieces of about CHUNK_BYTES."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        held[lang].append(text)
        sizes[lang] += len(text)
        if sizes[lang] > CHUNK_BYTES:
            yield lang, held.pop(lang)
            sizes.pop(lang)
    yield from held.items()


def counted(docs: DataFrame, rule: Pass, least: int) -> DataFrame:
    """Phrases that a pass counts ``least`` times or more, and the word totals.

    Tasks hand on one row per phrase and fill, so the rows go straight to their phrase's
    task without another round of partial sums.
    """
    rows = partial_counts(docs, rule).repartition("lang", "k", "phrase")
    sums = rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | (F.col("k") == 0))


# --- mining ------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, least: int, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, f): all words and phrases of at most ``longest`` (2 or 3) words
    that occur ``least`` times or more in a language, and the word totals as k = 0.

    ``docs`` is (key, lang, text as bytes). The sample takes one document in ``sample`` by a
    hash; its size only decides how many passes follow (three at most), not the result.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have 2 or 3 words")
    drawn = docs.where(F.pmod(F.xxhash64("key", "text"), F.lit(sample)) == 0).select("lang", "text")
    proposed = stored(counted(drawn, Pass(longest=2), sample_least), "phrases-sample")
    rule = Pass(bit_map(proposed, 1), bit_map(proposed, 2), longest=longest)
    bodies = docs.select("lang", "text")
    frequent = stored(counted(bodies, rule, least), "phrases-counted")
    while True:
        words, pairs = bit_map(frequent, 1), bit_map(frequent, 2)
        # a frequent word or pair outside of every earlier map is a border failure
        words_seen, pairs_seen = (*rule.words_before, rule.words), (*rule.pairs_before, rule.pairs)
        failed = [bool((new & ~np.bitwise_or.reduce(seen)).any()) for new, seen in ((words, words_seen), (pairs, pairs_seen))]
        if not failed[0] and not (failed[1] and longest > 2):
            return frequent
        rule = Pass(words, pairs, words_seen, pairs_seen, longest)
        more = stored(counted(bodies, rule, least), "phrases-counted")
        frequent = frequent.unionByName(more)


def cuts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds l, r and score of a candidate's lowest-scoring cut, ties to the first cut."""
    words = F.split("phrase", " ")
    places = F.sequence(F.lit(1), F.size(words) - 1)
    parted = candidates.select("lang", "phrase", "a", F.explode(places).alias("cut")).select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.size(words) - F.col("cut")), " ").alias("right"),
    )
    known = counts.where("k > 0")
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    joined = parted.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    above = F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]
    score = F.call_function("div", above.cast("decimal(38,0)"), (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return joined.groupBy("lang", "phrase").agg(F.first("a").alias("a"), best.alias("best")).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )


def independent(candidates: DataFrame, share: int) -> DataFrame:
    """Candidates without those that a longer candidate holds ``share`` percent of."""
    words = F.split("phrase", " ")
    size = F.size(words)
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ))
    held = (
        candidates.where(size > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    joined = candidates.join(held, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000, longest: int = LONGEST,
    key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases per language.

    Phrases of two to ``longest`` words with a count of ``least`` or more; null lang is
    ``und``, null text has no words, repeated rows count again, equal scores rank by count
    and then by the bytes of the phrase. A text of any length is counted whole. An empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
    )
    found = frequent_phrases(rows, least, sample, sample_least, longest)
    candidates = found.where("k > 1").select("lang", "phrase", F.col("f").alias("a"))
    scored = cuts(independent(candidates, share), found)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 10, share: int = 50, most: int = 2000) -> str:
    """SQL for the collocations of the documents table."""
    return f"""WITH pieces AS (SELECT row_number() OVER () AS piece, lang, words FROM (
      SELECT lang, regexp_extract_all(body, '[^\\x20\\x09]+') AS words FROM (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]', chr(10), 'g'), chr(10))) AS body FROM documents)) WHERE len(words) > 0),
    said AS (SELECT lang, piece, unnest(words) AS w1, generate_subscripts(words, 1) AS place FROM pieces),
    runs AS (SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM said
      WINDOW p AS (PARTITION BY piece ORDER BY place)),
    counts AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM runs GROUP BY lang, w1
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= {least}
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM runs WHERE w3 IS NOT NULL
        GROUP BY lang, w1, w2, w3 HAVING count(*) >= {least}),
    keyed AS MATERIALIZED (SELECT *, lang || chr(10) || phrase AS name FROM counts),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM keyed WHERE k = 1 GROUP BY lang),
    triples AS (SELECT lang, f, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3
      FROM keyed WHERE k = 3),
    longer AS (SELECT name, max(f) AS f FROM (SELECT f, lang || chr(10) || unnest([w1 || ' ' || w2, w2 || ' ' || w3]) AS name
      FROM triples) GROUP BY name),
    kept AS (SELECT c.lang, c.k, c.phrase, c.f AS a FROM keyed c LEFT JOIN longer o ON o.name = c.name
      WHERE c.k > 1 AND NOT coalesce(100 * o.f >= {share} * c.f, FALSE)),
    parted AS (SELECT lang, phrase, a, 1 AS cut, split_part(phrase, ' ', 1) AS lp, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) AS rp FROM kept
      UNION ALL SELECT lang, phrase, a, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3)
      FROM kept WHERE k = 3),
    scored AS (SELECT p.lang, p.phrase, p.a, x.f AS l, y.f AS r,
        (CAST(1000000 AS HUGEINT) * p.a * p.a) // (CAST(x.f AS HUGEINT) * y.f) AS score, p.cut
      FROM parted p JOIN keyed x ON x.name = p.lang || chr(10) || p.lp JOIN keyed y ON y.name = p.lang || chr(10) || p.rp),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored) WHERE place = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {most}"""
