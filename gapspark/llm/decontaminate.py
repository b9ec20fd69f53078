"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into half-overlapping passages of ``2 * HALF`` words. Passages and benchmark
items are TF-IDF vectors over the words of the items (document frequencies count all
documents). A randomised SVD of the passages of all distinct documents, and of the items,
gives a latent space. Texts are read once for it and kept as numbers of words; the passes
over these add up partial matrices whose size the benchmark sets. Every passage of every
document is projected and searched
against all items by cosine and by the share of the item it holds. Candidates are then
read again: the longest common subsequence of words, and the item's answer, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapspark.llm.common import memo_of_task, stored, unused

WORDS = re.compile(r"[^\W_]+").findall
HALF = 24
RANK = 160
OVERSAMPLE = 16
#: Words, and half passages, that are summed at once: their rows stay in a core's cache.
CHUNK = 1 << 12
#: Rows of a run that are added for all runs together; what a run has beyond is added for it alone.
ROUNDS = 16
#: Rows of a partial matrix that are added up as one.
BLOCK_ROWS = 512
#: Items of one search; a larger benchmark is searched in blocks of so many.
BLOCK_ITEMS = 20_000
#: A word in more than this share of the documents tells little.
COMMON = 0.05
LEAST_WORDS = 10
LEAST_COSINE = 0.40
LEAST_MASS = 0.50
LEAST_LCS = 0.70
LEAST_ANSWER = 0.50
#: Without an answer of its own, an item's rarest third of words (this many at least) is it.
ANSWER_WORDS = 3


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


class Vocabulary(dict):
    """Row of a word in the space, -1 for words outside it."""

    def __missing__(self, word: str) -> int:
        return -1


@dataclass
class Item:
    item_id: int
    words: list[str]
    answer: set[str]


@dataclass
class Index:
    rows: Vocabulary
    weight: np.ndarray  # of each row: inverse document frequency
    basis: np.ndarray  # rows x rank, with the weights
    queries: np.ndarray  # query pieces x rank
    norms: np.ndarray
    item_of: np.ndarray  # item of each query piece
    items: list[Item]


def coded(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The documents' words as numbers in the vocabulary (-1: not in it), with a number and
    a hash of each text, written."""
    kind = np.int16 if len(vocabulary) < 1 << 15 else np.int32
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of_task(None)
        number = Vocabulary({w: i for i, w in enumerate(shared.value)})
        for batch in batches:
            codes = []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                codes.append(np.fromiter(map(number.__getitem__, words), dtype=kind, count=len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes, pa.binary())], names=["hash", "row", "codes"])

    rows = docs.select("text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    return stored(rows.mapInArrow(run, "hash long, row long, codes binary"), "coded-documents")


def document_frequencies(codes: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Documents that hold each word, over all documents, and the number of documents."""
    size = len(vocabulary)
    kind = np.int16 if size < 1 << 15 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, dtype=np.int64)  # the last one counts documents
        for batch in batches:
            for code in batch.column(0).to_pylist():
                own = np.unique(np.frombuffer(code, dtype=kind))
                seen[own[own >= 0]] += 1
                seen[size] += 1
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held])], names=["word", "n"])

    table = codes.select("codes").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = dict(table.collect())  # a row for each word of the items
    total = counts.pop(size, 0)
    return {vocabulary[i]: n for i, n in counts.items()}, total


def telling_words(codes: DataFrame, vocabulary: list[str], rows: Vocabulary) -> DataFrame:
    """Of each distinct text its number of half passages, and row and half of each word that
    has a row in the space; texts without such a word are left out. Written."""
    kind = np.int16 if len(vocabulary) < 1 << 15 else np.int32
    row_of = np.array([*map(rows.__getitem__, vocabulary), -1], dtype=np.int32)  # of -1: the last one
    shared = codes.sparkSession.sparkContext.broadcast(row_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, halves, ids, places = [], [], [], []
            for number, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shared.value[np.frombuffer(code, dtype=kind)]
                at = np.flatnonzero(own >= 0)
                if len(at):
                    numbers.append(number)
                    halves.append(-(-len(own) // HALF))
                    ids.append(own[at].tobytes())
                    places.append((at // HALF).astype(np.int32).tobytes())
            arrays = [pa.array(numbers, pa.int64()), pa.array(halves, pa.int64()), pa.array(ids, pa.binary()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "halves", "ids", "places"])

    # of equal texts one counts; only their numbers and the telling words travel for it
    firsts = codes.groupBy("hash").agg(F.min("row").alias("row")).select("row")
    telling = codes.select("row", "codes").mapInArrow(run, "row long, halves long, ids binary, places binary")
    return stored(telling.join(firsts, "row", "left_semi").drop("row"), "telling-words")


def run_sums(keys: np.ndarray, picked: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, each once, and for each the sum of the table's rows picked in its run; equal
    keys follow each other. The longest runs come first."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(starts, append=len(keys))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    sums = table[picked[starts]]
    for k in range(1, min(int(sizes[0]), ROUNDS)):
        n = len(sizes) - int(np.searchsorted(sizes[::-1], k, side="right"))
        sums[:n] += table[picked[starts[:n] + k]]
    for i in np.flatnonzero(sizes > ROUNDS):
        sums[i] += table[picked[starts[i] + ROUNDS : starts[i] + sizes[i]]].sum(axis=0)
    return keys[starts], sums


def passages(rows: np.ndarray, places: np.ndarray, sizes: np.ndarray, halves: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the table's rows over each passage of some texts, and the first slot of
    each text. ``rows`` and ``places`` are row and half of their known words, text by text,
    ``sizes`` the known words of each text, ``halves`` its half passages.

    Passage i holds words HALF * i to HALF * (i + 2); a text of at most HALF words is one.
    It is in slot 1 + i of its text; the slots that begin no passage hold zeros, the first one
    of each text among them, so that neighbours never reach into another text.
    """
    ends = np.cumsum(halves + 1)
    bases = ends - halves - 1
    sums = np.zeros((ends[-1] + 1, table.shape[1]), dtype=np.float32)
    if len(rows):
        slots, found = run_sums(places + np.repeat(bases + 1, sizes), rows, table)
        sums[slots] = found
    sums[:-1] += sums[1:]
    sums[bases] = 0
    sums[ends[halves > 1] - 1] = 0
    return sums, bases


def chunks(sizes: np.ndarray, halves: np.ndarray) -> list[tuple[int, int]]:
    """Texts, from and to, that go together until their words or slots fill a chunk."""
    chunk = np.maximum(np.cumsum(sizes), np.cumsum(halves + 1)) // CHUNK
    cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def query_pieces(words: list[str]) -> list[list[str]]:
    """An item as pieces of at most a passage's words, of like size."""
    n = max(1, -(-len(words) // (2 * HALF)))
    cuts = np.linspace(0, len(words), n + 1).round().astype(int)
    return [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def gram_of(rows: np.ndarray, places: np.ndarray, sizes: np.ndarray, halves: np.ndarray, table: np.ndarray, out: np.ndarray) -> None:
    """Adds, for each word of some texts, the table's rows summed over the passages that hold
    it to the word's row of out."""
    sums, bases = passages(rows, places, sizes, halves, table)
    both = sums[1:] + sums[:-1]  # a word is in the passages of its half and of the half before
    slots = places + np.repeat(bases, sizes)
    order = np.argsort(rows, kind="stable")
    own, found = run_sums(rows[order], slots[order], both)
    out[own] += found


def gram_pass(telling: DataFrame, weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q for the passage vectors of all texts, summed over the tasks' partial products.

    The partial products meet in blocks of rows, so the driver gets one matrix, however
    many tasks there are."""
    shared = telling.sparkSession.sparkContext.broadcast((weight, q))
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, basis = shared.value
        table = (basis * scale[:, None]).astype(np.float32)
        out = np.zeros(basis.shape)
        for batch in batches:
            halves = batch.column(0).to_numpy()
            ids, places = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            for a, b in chunks(sizes, halves):
                rows, at = (np.frombuffer(b"".join(x[a:b]), dtype=np.int32) for x in (ids, places))
                gram_of(rows, at, sizes[a:b], halves[a:b], table, out)
        out = (out * scale[:, None]).astype(np.float32)
        blocks = range(0, len(out), BLOCK_ROWS)
        parts = [out[at : at + BLOCK_ROWS].tobytes() for at in blocks]
        yield pa.RecordBatch.from_arrays([pa.array([*blocks], pa.int64()), pa.array(parts, pa.binary())], names=["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(part, dtype=np.float32).astype(np.float64)
        parts = [x.tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array(parts, pa.binary())], names=["at", "part"])

    kind = "at long, part binary"
    tasks = min(telling.sparkSession.sparkContext.defaultParallelism, -(-len(q) // BLOCK_ROWS))
    found = telling.mapInArrow(run, kind).repartition(max(1, tasks), "at").mapInArrow(add, kind).toArrow()
    total = np.zeros(q.shape)
    for at, part in zip(found["at"].to_pylist(), found["part"].to_pylist(), strict=True):
        total[at : at + BLOCK_ROWS] = np.frombuffer(part).reshape(-1, width)
    return total


def build_index(docs: DataFrame, items: list[Item]) -> Index:
    """Fit the space on all documents and the items, and project the items."""
    vocabulary = sorted({w for item in items for w in item.words})
    codes = coded(docs, vocabulary)
    counts, total = document_frequencies(codes, vocabulary)
    # words of many documents are left out, but each item keeps its rarest LEAST_WORDS
    idf = {w: float(np.log((total + 1) / (counts.get(w, 0) + 1))) + 0.05 for w in vocabulary}
    telling = {w for w in vocabulary if counts.get(w, 0) <= COMMON * total}
    for item in items:
        telling.update(sorted(set(item.words), key=lambda w: (-idf[w], w))[:LEAST_WORDS])
    rows = Vocabulary({w: i for i, w in enumerate(sorted(telling))})
    weight = np.array([max(idf[w], 0.05) for w in sorted(telling)])
    for item in items:
        rarest = sorted(set(item.words), key=lambda w: (-idf[w], w))
        item.answer = item.answer or set(rarest[: max(ANSWER_WORDS, len(rarest) // 3)])
    pieces = [(k, p) for k, item in enumerate(items) for p in query_pieces(item.words) if p]
    vectors = np.zeros((len(pieces), len(rows)), dtype=np.float32)
    for row, (_, p) in zip(vectors, pieces, strict=True):
        np.add.at(row, [rows[w] for w in p if rows[w] >= 0], 1)
    vectors *= weight.astype(np.float32)
    width = min(len(rows), RANK + OVERSAMPLE)
    rank = min(RANK, width)
    telling_of = telling_words(codes, vocabulary, rows)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(rows), width)))[0] if len(rows) else np.zeros((0, 0))
    # the items weigh as much as the documents in the fitted matrix
    heavy = None
    for _ in range(2 if len(rows) else 0):
        corpus = gram_pass(telling_of, weight, q)
        own = vectors.T @ (vectors @ q)
        if heavy is None:
            heavy = max(1.0, float(np.linalg.norm(corpus) / max(np.linalg.norm(own), 1e-9)))
        q = np.linalg.qr(corpus + heavy * own)[0]
    if len(rows):
        small = q.T @ (gram_pass(telling_of, weight, q) + heavy * (vectors.T @ (vectors @ q)))
        values, turn = np.linalg.eigh((small + small.T) / 2)
        q = q @ turn[:, np.argsort(-values)[:rank]]
    queries = vectors @ q
    basis = (q * weight[:, None]).astype(np.float32)
    return Index(rows, weight, basis, queries.astype(np.float32), np.linalg.norm(queries, axis=1).astype(np.float32) if len(pieces) else np.zeros(0, np.float32),
                 np.array([k for k, _ in pieces], dtype=np.int64), items)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = state & places.get(w, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def verify(item: Item, words: list[str], at: int) -> tuple[float, float]:
    """Share of the item in the longest common subsequence near a passage, and of its answer."""
    n = len(item.words)
    start = max(0, at * HALF - n)
    region = words[start : at * HALF + 2 * HALF + n]
    share = lcs(item.words, region) / n
    answer = len(item.answer.intersection(region)) / len(item.answer) if item.answer else 1.0
    return share, answer


def search(texts: list[str], index: Index) -> list[list[tuple[int, float, float, float]]]:
    """Per text its (item, cosine, lcs, answer) that pass, best passage of each item."""
    out: list[list] = [[] for _ in texts]
    if not len(index.queries):
        return out
    floor = LEAST_MASS * float(index.norms[index.norms > 0].min()) if (index.norms > 0).any() else np.inf
    all_words = [words_of(text) for text in texts]
    known, vectors, owner, place = [], [], [], []
    for words in all_words:
        rows = np.fromiter(map(index.rows.__getitem__, words), dtype=np.int64, count=len(words))
        at = np.flatnonzero(rows >= 0)
        known.append((rows[at], at // HALF))
    sizes = np.array([len(rows) for rows, _ in known], dtype=np.int64)
    halves = np.array([-(-len(words) // HALF) for words in all_words], dtype=np.int64)
    for a, b in chunks(sizes, halves):
        rows, at = (np.concatenate(x) for x in zip(*known[a:b], strict=True))
        got, bases = passages(rows, at, sizes[a:b], halves[a:b], index.basis)
        length = np.einsum("ij,ij->i", got, got)
        # what is shorter than the least share of the shortest item holds no item
        ok = np.flatnonzero(length >= floor * floor)
        if len(ok):
            text = np.searchsorted(bases, ok, side="right") - 1
            vectors.append(got[ok])
            owner.append(a + text)
            place.append(ok - bases[text] - 1)
    if not vectors:
        return out
    x, owner, place = np.concatenate(vectors), np.concatenate(owner), np.concatenate(place)
    norms = np.linalg.norm(x, axis=1)
    best: dict[tuple[int, int], tuple] = {}
    for at in range(0, len(x), 4096):
        dots = x[at : at + 4096] @ index.queries.T
        q = index.norms
        hit = (dots >= LEAST_MASS * q * q) & (dots >= LEAST_COSINE * norms[at : at + 4096, None] * q) & (q > 0)
        for i, j in zip(*np.nonzero(hit), strict=True):
            k, item = int(owner[at + i]), int(index.item_of[j])
            old = best.get((k, item))
            if old is not None and old[1] >= 0.999:
                continue
            share, answer = verify(index.items[item], all_words[k], int(place[at + i]))
            if share >= LEAST_LCS and answer >= LEAST_ANSWER:
                found = (float(dots[i, j] / max(norms[at + i] * q[j], 1e-9)), share, answer)
                if old is None or (found[1], found[0]) > (old[1], old[0]):
                    best[k, item] = found
    for (k, item), (cosine, share, answer) in best.items():
        out[k].append((index.items[item].item_id, cosine, share, answer))
    return out


HITS = "array<struct<item_id: bigint, cosine: double, lcs: double, answer: double>>"


def read_items(benchmark: DataFrame, text: str, key: str, answer: str | None) -> list[Item]:
    columns = [F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{answer}`") if answer else F.lit(None).cast("string")]
    got = [Item(r[0], words_of(r[1]), set(words_of(r[2] or ""))) for r in benchmark.select(*columns).where(F.col(key).isNotNull()).toLocalIterator()]
    return sorted((i for i in got if i.words), key=lambda i: (i.item_id, i.words))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id", answer: str | None = None, hits: str = "__hits") -> DataFrame:
    """The documents with ``hits``, the items found in each (array of item_id, cosine,
    lcs, answer).

    The benchmark is the query set: it is read into the driver and searched in blocks of
    BLOCK_ITEMS. Documents are searched row by row, whole, without a shuffle. Without an
    ``answer`` column an item's rarest words are its answer. Items without words or id find
    nothing; null and empty documents have no hit; repeated items and documents are each
    found; an empty table on either side gives no hit. All columns of the documents stay.
    """
    items = read_items(benchmark, item_text, item_key, answer)
    texts = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{hits} {HITS}").fields])
    position = docs.columns.index(text)
    blocks = [build_index(texts, items[a : a + BLOCK_ITEMS]) for a in range(0, len(items), BLOCK_ITEMS)]
    shared = docs.sparkSession.sparkContext.broadcast(blocks)  # bounded by the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of_task(None)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
        for batch in batches:
            column = [x or "" for x in batch.column(position).to_pylist()]
            hits: list[list] = [[] for _ in column]
            for index in shared.value:
                for at in range(0, len(column), 200):
                    for k, found in enumerate(search(column[at : at + 200], index)):
                        hits[at + k] += [dict(zip(("item_id", "cosine", "lcs", "answer"), h, strict=True)) for h in sorted(found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document and item found in it: key, item_id, cosine, lcs, answer."""
    marked = mark(docs.select(F.col(f"`{key}`").alias(key), "text"), benchmark)
    return marked.select(key, F.inline("__hits"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item was found, with their columns, whatever their names."""
    hits = unused(docs, "__hits")
    return mark(docs, benchmark, hits=hits).where(F.size(hits) == 0).drop(hits)
