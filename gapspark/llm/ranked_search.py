"""Ranked lexical search: document tries searched depth first with bounds per item.

Documents become term vectors restricted to the terms of the query items. A task sorts its
vectors, terms in order of document frequency, into a trie: documents with a common
beginning are neighbours and share a node, copies share their whole path. Each node knows,
over all documents below it, the greatest count of every term and the smallest length
measure m. The score formula rises with the count and falls with m, so both give an upper
bound per item; a subtree that cannot reach the ten best scores found so far is left out
for that item. Only the ten best per task and item leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gapspark.llm.common import stored

#: (item, term) pairs of one block of items: what is broadcast at a time.
BLOCK_PAIRS = 200_000
#: Cells of a dense weight table (terms x items) in a task.
GROUP_CELLS = 4_000_000
#: Entries (document, term) of one trie, and documents of a bucket at its bottom.
TREE_ENTRIES, BUCKET = 1_500_000, 64
#: Code points of terms: all but ASCII marks and blanks. On UTF-8 bytes, bytes above 0x7F
#: belong to terms, so cutting bytes cuts between code points.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TO_TERMS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))
FLAT = 90


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of term characters of a UTF-8 text, A-Z in lower case."""
    return text.translate(TO_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_measure(n: int, n_docs: int, total: int) -> int:
    return 100 - FLAT + (FLAT * n * n_docs) // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight gains from tf occurrences; rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- items and vectors -------------------------------------------------------


def item_pairs(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (key, term). Rows that share a key are one item; null texts have no terms."""
    found = items.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").cast("binary").alias("body"))
    schema = StructType([StructField("item", LongType()), StructField("term", found.schema["body"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, t) for i, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in set(terms_of(b or b""))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["item", "term"]
                )

    return found.mapInArrow(run, schema).distinct()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc, n, terms, tfs) of documents with at least one term; ``vocabulary`` numbers the
    terms that are kept, in ascending order in a vector."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    body = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            docs_, sizes, ends, terms, tfs = [], [], [0], [], []
            for doc, text_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                said = terms_of(text_ or b"")
                if not said:
                    continue
                got = np.array([numbers[t] for t in said if t in numbers], np.int32)
                term, tf = np.unique(got, return_counts=True)
                docs_.append(doc)
                sizes.append(len(said))
                terms.append(term)
                tfs.append(tf.astype(np.int32))
                ends.append(ends[-1] + len(term))
            if docs_:
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"]
                )

    return body.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents per term number, counted in the tasks and summed; ``size`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        told = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.int64()), pa.array(counts[told])], names=["term", "df"])

    rows = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


# --- the trie of a task ------------------------------------------------------


@dataclass
class Node:
    """Documents first to last - 1 in trie order; greatest counts and smallest m below."""

    first: int
    last: int
    children: list
    terms: np.ndarray | None = None
    most: np.ndarray | None = None
    least_m: int = 0


def shared_lengths(keys: list[bytes]) -> np.ndarray:
    """Terms that neighbours in sorted order have in common at the beginning."""
    out = np.zeros(len(keys) + 1, np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        size = min(len(a), len(b))
        same = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
        out[i] = (int(same.argmax()) if same.any() else size) // 4
    return out


class Trie:
    """Documents of a chunk in trie order. ``rank`` places the terms, frequent ones first."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, rank: np.ndarray):
        owner = np.repeat(np.arange(len(docs)), np.diff(ends))
        order = np.lexsort((rank[terms], owner))
        placed, terms, tfs = rank[terms][order].astype(">u4"), terms[order], tfs[order]
        keys = [placed[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        by = sorted(range(len(docs)), key=keys.__getitem__)
        self.docs, self.m = docs[by], m[by]
        sizes = np.diff(ends)[by]
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(ends[:-1][by] - self.ends[:-1], sizes) + np.arange(len(terms))
        self.terms, self.tfs = terms[take], tfs[take].astype(np.int64)
        self.shared = shared_lengths([keys[i] for i in by])
        self.root = self._node(0, len(docs))

    def _node(self, first: int, last: int) -> Node:
        """The smallest subtree over a range of documents. Small neighbouring subtrees are
        put into one bucket; equal vectors in large number are halved."""
        node = Node(first, last, [])
        todo, made = [node], []
        while todo:
            at = todo.pop()
            made.append(at)
            if at.last - at.first <= BUCKET:
                continue
            inner = self.shared[at.first + 1 : at.last]
            marks = np.flatnonzero(inner == inner.min()) + at.first + 1
            edges = [at.first, *marks.tolist(), at.last]
            if inner.min() == inner.max():
                middle = range(at.first, at.last, BUCKET)
                edges = [*middle, at.last]
            begin = at.first
            for a, b in zip(edges, edges[1:], strict=False):
                if b - begin > BUCKET and a > begin:
                    at.children.append(Node(begin, a, []))
                    begin = a
            at.children.append(Node(begin, at.last, []))
            todo += at.children
        for at in reversed(made):
            self._sum_up(at)
        return node

    def _sum_up(self, node: Node) -> None:
        if node.children:
            terms = np.concatenate([c.terms for c in node.children])
            counts = np.concatenate([c.most for c in node.children])
            node.least_m = min(c.least_m for c in node.children)
        else:
            inside = slice(self.ends[node.first], self.ends[node.last])
            terms, counts = self.terms[inside], self.tfs[inside]
            node.least_m = int(self.m[node.first : node.last].min())
        order = np.argsort(terms, kind="stable")
        terms, counts = terms[order], counts[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        node.terms = terms[starts]
        node.most = np.maximum.reduceat(counts, starts) if len(starts) else counts


class Group:
    """Items searched together: a dense weight table over the terms they have."""

    def __init__(self, weights: list[tuple[np.ndarray, np.ndarray]], size: int):
        own = np.unique(np.concatenate([t for t, _ in weights])) if weights else np.zeros(0, np.int64)
        self.row = np.full(size, -1)
        self.row[own] = np.arange(len(own))
        most = max((int(w.sum()) for _, w in weights), default=0) * 1_000_000
        # whole numbers below 2^53 are exact in doubles, which multiply faster
        self.table = np.zeros((len(own), len(weights)), np.float64 if most < 1 << 53 else np.int64)
        for i, (terms, w) in enumerate(weights):
            self.table[self.row[terms], i] = w

    def worth(self, terms: np.ndarray, gain: np.ndarray, items: np.ndarray) -> np.ndarray:
        rows = self.row[terms]
        told = rows >= 0
        return gain[told].astype(self.table.dtype) @ self.table[np.ix_(rows[told], items)]


class Best:
    """The best documents per item so far, by score and then document number."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        scores = np.concatenate([self.found[item][0], scores])
        docs = np.concatenate([self.found[item][1], docs])
        first = np.lexsort((docs, -scores))[: self.k]
        self.found[item] = (scores[first], docs[first])
        if len(first) == self.k:
            self.least[item] = scores[first[-1]]


def search(trie: Trie, group: Group, best: Best, items: np.ndarray, visited: list | None = None) -> None:
    """Depth first, nearest bound first; ``items`` are the numbers in ``best`` of the
    group's columns. An item leaves a subtree whose bound is below its least score."""
    todo = [(trie.root, np.arange(len(items)))]
    while todo:
        node, alive = todo.pop()
        bound = group.worth(node.terms, impact(node.most, np.int64(node.least_m)), alive)
        alive = alive[bound >= best.least[items[alive]]]
        if visited is not None:
            visited.append((node, alive))
        if not len(alive):
            continue
        if node.children:
            todo += [(c, alive) for c in reversed(node.children)]
            continue
        inside = slice(trie.ends[node.first], trie.ends[node.last])
        rows = group.row[trie.terms[inside]]
        owner = np.repeat(np.arange(node.last - node.first), np.diff(trie.ends[node.first : node.last + 1]))
        gain = impact(trie.tfs[inside], trie.m[node.first : node.last][owner])
        used, column = np.unique(rows[rows >= 0], return_inverse=True)
        dense = np.zeros((node.last - node.first, len(used)), group.table.dtype)
        dense[owner[rows >= 0], column] = gain[rows >= 0]
        scores = (dense @ group.table[np.ix_(used, alive)]).astype(np.int64)
        good = scores >= best.least[items[alive]]
        for column in np.flatnonzero(good.any(axis=0)):
            rows = good[:, column]
            best.add(int(items[alive[column]]), scores[rows, column], trie.docs[node.first : node.last][rows])


def chunks(batches: Iterator[pa.RecordBatch], entries: int):
    """Vectors in pieces of about ``entries`` entries; longer ones come alone."""
    held, size = [], 0
    for batch in batches:
        counts = np.diff(batch.column("terms").offsets.to_numpy())
        begin = 0
        for i, n in enumerate(counts):
            if size and size + n > entries:
                held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, begin = [], 0, i
            size += int(n)
        held.append(batch.slice(begin))
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


# --- the operator ------------------------------------------------------------

LAST = np.iinfo(np.int64).max


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents per item, score above 0.

    Equal scores rank by ascending doc_id, a null one last; rows that share a doc_id are
    documents of their own. Items are taken in blocks of about ``block_pairs`` terms by a
    hash of their key; each block reads the documents once. Rows of one item key are one
    item. Items without terms, and empty tables, give no rows. Keys are numbers; other
    columns are not read.
    """
    pairs = stored(item_pairs(items, item_key, item_text), "search-items")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    found = None
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        part = _search_block(docs, own, k, key, text)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(docs: DataFrame, pairs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    told = pairs.orderBy("item", "term").toArrow()  # a block of items
    asked = told.column("item").to_pylist()
    names = list(dict.fromkeys(asked))
    places = {name: i for i, name in enumerate(names)}
    items = np.array([places[name] for name in asked], np.int64)
    words = told.column("term").to_pylist()
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    numbers = np.array([vocabulary[w] for w in words], np.int64)
    found = stored(vectors(docs, vocabulary, key, text), "search-vectors")
    size = len(vocabulary)
    df = frequencies(found, size)
    n_docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    w = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), -df))] = np.arange(size)
    lists = [(numbers[items == i], w[numbers[items == i]]) for i in range(len(names))]
    shared = docs.sparkSession.sparkContext.broadcast((names, lists, rank))
    schema = StructType([StructField("item_id", LongType()), StructField("doc_id", LongType()), StructField("score", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists, rank = shared.value
        best = Best(len(names), k)
        per = max(1, GROUP_CELLS // max(1, size))
        groups = [np.arange(a, min(a + per, len(names))) for a in range(0, len(names), per)]
        kept = Group(lists, size) if len(groups) == 1 else None
        for chunk in chunks(batches, TREE_ENTRIES):
            ids = chunk.column("doc").combine_chunks()
            docs_ = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
            m = np.array([length_measure(n, n_docs, total) for n in chunk.column("n").to_pylist()], np.int64)
            column = chunk.column("terms").combine_chunks()
            ends = column.offsets.to_numpy().astype(np.int64)
            terms, tfs = (chunk.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            trie = Trie(docs_, m, ends - ends[0], terms, tfs, rank)
            for own in groups:
                search(trie, kept or Group([lists[i] for i in own], size), best, own)
        for item, (scores, docs_) in enumerate(best.found):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[item]] * len(scores), pa.int64()), pa.array(docs_, mask=docs_ == LAST), pa.array(scores)],
                    names=["item_id", "doc_id", "score"],
                )

    return found.where(F.size("terms") > 0).mapInArrow(run, schema)


def oracle() -> str:
    """SQL for the ranking of the documents per benchmark item."""
    def terms(table: str, key: str) -> str:
        return f"""SELECT {key}, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"""

    return f"""WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
    said AS ({terms('docs', 'doc, doc_id')}),
    sizes AS (SELECT doc, count(*) AS n FROM said GROUP BY doc),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    asked AS (SELECT DISTINCT item_id, term FROM ({terms('benchmark', 'item_id')})),
    counts AS (SELECT doc, doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    dfs AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM counts, whole GROUP BY term, docs),
    scores AS (SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) //
        (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
      FROM asked JOIN dfs USING (term) JOIN counts USING (term) JOIN sizes USING (doc), whole GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
      FROM scores WHERE score > 0)
    SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10"""
