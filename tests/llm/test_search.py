"""Ranked search against plain scores of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    bags = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(size for _, _, size in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, bag, size in bags:
            m = 10 + 90 * size * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in terms if t in bag
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **options):
    return sorted((tuple(r) for r in rs.ranked_search(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"block_pairs": 300}])
def test_equal_to_scoring_every_document(spark, folder, options):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), options.get("k", 10))
    assert ranked(docs, items, **options) == want


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "one five", 0), (1, "Two", 0), (None, "three w5x5 ONE", 1), (2, None, 2), (3, "", 3), (4, "nowhere", 4), (9, "w1x1", 5)],
        "item_id long, text string, term int",
    )
    want = brute(odd.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert ranked(odd, items) == want
    assert ranked(none, items) == [] and ranked(odd, items.limit(0)) == []


def test_many_equal_scores_rank_by_id(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text"))
    docs = docs.unionAll(spark.range(10_000, 15_000).selectExpr("id", "'none of those'")).unionAll(spark.createDataFrame([(9999, "same but longer text with other words in it")], "doc_id long, text string"))
    items = spark.createDataFrame([(1, "same words"), (2, "other")], "item_id long, text string")
    got = ranked(docs.repartition(7), items)
    assert [r[2] for r in sorted(g for g in got if g[0] == 1)] == list(range(10))
    assert [g[2] for g in got if g[0] == 2] == [9999]


def built(sizes=400, seed=5):
    rng = np.random.default_rng(seed)
    sets = [np.unique(np.concatenate([rng.integers(0, 20, 6), rng.integers(0, 300, rng.integers(1, 30)) * (1 + i // 200)])) for i in range(sizes)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    terms = np.concatenate(sets)
    tfs = rng.integers(1, 6, len(terms))
    df = np.bincount(terms, minlength=700)
    rank = np.empty(700, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(700)
    m = rng.integers(10, 400, sizes)
    return rs.Trie(np.arange(sizes), m, ends, terms, tfs, rank), rank


def test_nodes_bound_their_documents():
    trie, rank = built()
    todo, leaves = [trie.root], 0
    while todo:
        node = todo.pop()
        todo += node.children
        inside = slice(trie.ends[node.first], trie.ends[node.last])
        most = {}
        for t, tf in zip(trie.terms[inside].tolist(), trie.tfs[inside].tolist(), strict=True):
            most[t] = max(tf, most.get(t, 0))
        assert dict(zip(node.terms.tolist(), node.most.tolist(), strict=True)) == most
        assert node.least_m == trie.m[node.first : node.last].min()
        if node.children:
            assert [c.first for c in node.children] + [node.last] == [node.first] + [c.last for c in node.children]
        else:
            leaves += 1
            assert node.last - node.first <= rs.BUCKET
    assert leaves > 3
    paths = [rank[trie.terms[a:b]].tolist() for a, b in zip(trie.ends, trie.ends[1:], strict=False)]
    assert paths == sorted(paths)


def test_subtrees_that_cannot_win_are_left_out():
    """A rare term leads to the buckets of its documents; the other subtrees are not entered."""
    trie, _ = built()
    counts = np.bincount(trie.terms, minlength=700)
    rare = int(np.argmin(np.where(counts, counts, 999)))
    holders = {int(np.searchsorted(trie.ends, i, "right")) - 1 for i in np.flatnonzero(trie.terms == rare)}
    group = rs.Group([(np.array([rare]), np.array([10])), (np.array([699]), np.array([5]))], 700)
    best, visited = rs.Best(2, 3), []
    rs.search(trie, group, best, np.arange(2), visited)
    entered = [node for node, alive in visited if len(alive)]
    assert all(alive.tolist() in ([], [0]) for _, alive in visited)
    assert len(entered) < len(visited)
    assert all(any(n.first <= d < n.last for d in holders) for n in entered)
    assert len(best.found[0][0]) == min(3, len(holders)) and len(best.found[1][0]) == 0
