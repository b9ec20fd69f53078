"""Jaccard groups, decontamination and the pipeline."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapspark.llm import decontaminate, jaccard
from gapspark.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_groups(texts, percent, n=3):
    sets = {k: shingle_set(t, n) for k, t in texts.items()}
    label = {k: k for k in sets}
    links = [
        (a, b) for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {k: (len(sets[k]), label[k]) for k in sets}


def corpus(seed):
    """Texts with chains of small edits, copies, shared passages and short texts."""
    random = np.random.default_rng(seed)
    words = [f"v{i}" for i in range(200)]
    passage = " ".join(random.choice(words, 40))
    texts = {}
    for k in range(12):
        text = list(random.choice(words, int(random.integers(1, 90))))
        for step in range(8):
            texts[len(texts)] = " ".join(text)
            for _ in range(int(random.integers(0, 4))):
                text[int(random.integers(0, len(text)))] = str(random.choice(words))
            if step == 5:
                texts[len(texts)] = " ".join(text).upper()
    for k in range(25):
        texts[len(texts)] = passage + " " + " ".join(random.choice(words, int(random.integers(0, 12))))
    for short in ("", None, "a", "A", "a b", "b a", "a b c", "a  b\nc"):
        texts[len(texts)] = short
    return texts


@pytest.mark.parametrize("percent, small, block", [(90, 64, 256), (60, 3, 4), (75, 64, 3), (50, 2, 16), (100, 64, 256)])
def test_groups_match_brute_force(spark, percent, small, block):
    texts = corpus(percent)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_groups(df, percent=percent, small=small, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(texts, percent)


def test_sketches_tell_large_sets_apart_and_keep_those_that_link(spark):
    """Large sets that share a quarter are no pair to compare; sets that link stay one, also
    where their sketches differ in length. One partner comes first, the others if apart."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 14_000, dtype=np.uint64))
    spans = {1: (0, 6000), 2: (4500, 10500), 3: (0, 2040), 4: (0, 2060), 5: (0, 9000), 6: (0, 300), 7: (0, 0)}
    sets = {i: keys[a:b] for i, (a, b) in spans.items()}
    rows = [(i, len(k), jaccard.parity_sketch(k).tolist()) for i, k in sets.items()]
    assert {i: len(k) for i, _, k in rows} == {1: 64, 2: 64, 3: 16, 4: 32, 5: 128, 6: 16, 7: 16}
    chosen = spark.createDataFrame(rows, "id long, size long, sketch array<long>")
    pairs = spark.createDataFrame([(b, a) for a in sets for b in sets if a < b], "id long, pivot long")
    assert sorted(map(tuple, jaccard.near(pairs, chosen, 90).collect())) == [(4, 3)]
    # fewer bits are the exclusive or of the parts of more
    one = jaccard.parity_sketch(sets[5]).reshape(-1, 32)
    got = chosen.where("id = 5").select(jaccard.folded("sketch", F.lit(32))).first()[0]
    assert got == np.bitwise_xor.reduce(one).tolist()


def test_only_partners_in_other_components_are_left(spark):
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (4, 3), (4, 2)], "id long, pivot long")
    assert sorted(map(tuple, jaccard.first_pivots(pairs).collect())) == [(2, 1), (3, 1), (4, 2)]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, component long")
    assert sorted(map(tuple, jaccard.apart(pairs, labels).collect())) == [(4, 2), (4, 3)]


def test_trie_finds_all_links():
    random = np.random.default_rng(3)
    sets = [np.unique(random.integers(0, 60, int(n))).astype(np.uint64) for n in random.integers(1, 40, 120)]
    sets += sets[:10]
    trie = jaccard.Trie(sets)
    for t in (30, 50, 80, 100):
        for q in sets[:40]:
            want = {i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= t * len(set(q) | set(s))}
            assert set(trie.links(q, t, lambda i: True)) == want


def test_trie_leaves_subtrees_that_cannot_link():
    """Sets of five families share long beginnings; a query of one family asks few leaves of the others."""
    random = np.random.default_rng(4)
    heads = [np.arange(100 * f, 100 * f + 30) for f in range(5)]
    sets = [np.concatenate([h, np.sort(random.choice(np.arange(1000, 1400), 6, replace=False))]).astype(np.uint64) for h in heads for _ in range(50)]
    trie = jaccard.Trie(sets)
    for at in range(0, 250, 10):
        asked = []
        found = trie.links(sets[at], 70, lambda i, asked=asked: asked.append(i) or True)
        want = {i for i, s in enumerate(sets) if 100 * len(set(sets[at]) & set(s)) >= 70 * len(set(sets[at]) | set(s))}
        assert set(found) == want and len(want) >= 5
        assert len(asked) <= 50 + 4  # its own family, and one leaf of each other one
    some = set(range(0, 250, 3))
    assert set(trie.links(sets[1], 70, some.__contains__)) == {
        i for i in some if 100 * len(set(sets[1]) & set(sets[i])) >= 70 * len(set(sets[1]) | set(sets[i]))}
    assert jaccard.Trie([]).links(sets[0], 70, some.__contains__) == [] == trie.links(sets[0][:0], 70, some.__contains__)


def test_groups_of_odd_rows(odd, none):
    got = jaccard.jaccard_groups(odd).collect()
    assert len(got) == 8
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id != 5) == [
        (0, 4, None), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 3, 1),
    ]
    assert jaccard.jaccard_groups(none).count() == 0


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    random = np.random.default_rng(5)
    for _ in range(200):
        a, b = ([str(x) for x in random.integers(0, 6, int(random.integers(1, 40)))] for _ in range(2))
        assert decontaminate.lcs(a, b) == plain(a, b)


def words_of(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


def test_all_verbatim_items_are_found(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    held = {r.item_id: words_of(r.text) for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in held.items() if t in words_of(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and want <= got and len(got) <= len(want) + 1


def test_paraphrases_and_clean_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(150)
    random = np.random.default_rng(9)
    items = table(spark, "/root/testdata/sf0.01", "benchmark").limit(12).collect()
    made = []
    for k, item in enumerate(items):
        words = item.text.split()
        for i in random.choice(len(words), max(1, len(words) // 10), replace=False):
            words[i] = "other"
        made.append((90_000 + k, "lead in " * 30 + " ".join(words) + " and out" * 20))
    planted = spark.createDataFrame(made, "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(planted)
    got = {r.doc_id for r in decontaminate.contaminated(whole, spark.createDataFrame(items)).collect()}
    assert len(got & {k for k, _ in made}) >= 11
    held = [words_of(i.text) for i in items]
    leaks = {r.doc_id for r in docs.collect() if any(t in words_of(r.text) for t in held)}
    assert got - {k for k, _ in made} == leaks


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "one two three four five"), (1, "one two three four five"), (2, None), (None, "one two"), (3, "")], "item_id long, text string"
    )
    found = decontaminate.contaminated(odd, items).collect()
    assert {r.doc_id for r in found} == {1, 6, None} and {r.item_id for r in found} == {1}
    assert decontaminate.clean(odd, items).columns == odd.columns
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_the_space_is_fitted_on_every_distinct_document(spark, monkeypatch):
    """More documents than any sample held: the space is that of the whole passage matrix."""
    monkeypatch.setattr(decontaminate, "RANK", 3)
    monkeypatch.setattr(decontaminate, "OVERSAMPLE", 100)
    random = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)] + ["other"] * 2_000
    texts = [" ".join([f"x{k}", *random.choice(names, int(random.integers(1, 130)))]) for k in range(2_600)]
    texts += ["", *["w1 w2 w3 " * 40] * 20]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    items = [decontaminate.Item(i, [f"w{j}" for j in range(i, i + 20)], set()) for i in range(0, 41, 10)]
    index = decontaminate.build_index(docs, items)
    seen = {w: sum(w in t.split() for t in texts) for w in index.rows}
    assert set(index.rows) == {f"w{i}" for i in range(60)}
    scale = np.array([max(np.log((len(texts) + 1) / (seen[w] + 1)) + 0.05, 0.05) for w in index.rows])
    assert np.allclose(index.weight, scale)

    def counted(words):
        row = np.zeros(len(index.rows))
        for w in words:
            row[index.rows[w]] += index.rows[w] >= 0
        return row * scale

    half, gram = decontaminate.HALF, np.zeros((len(scale), len(scale)))
    for words in (t.split() for t in set(texts)):
        for at in range(0, max(1, -(-len(words) // half) - 1)):
            row = counted(words[at * half : (at + 2) * half])
            gram += np.outer(row, row)
    own = np.array([counted(i.words) for i in items])
    whole = gram + max(1.0, np.linalg.norm(gram) / np.linalg.norm(own.T @ own)) * own.T @ own
    best = np.linalg.eigh(whole)[1][:, ::-1][:, :3]
    got = index.basis / scale[:, None]
    assert np.allclose(got @ got.T, best @ best.T, atol=1e-3)


def test_pipeline(spark, folder):
    import corpus_pipeline as p

    docs = table(spark, folder, "documents")
    kept = {r.doc_id for r in p.quality_rules_stage(spark, docs, folder).collect()}
    judged = {r.doc_id: r.kept for r in p.quality_rules.quality_rules(docs).collect()}
    assert kept == {k for k, ok in judged.items() if ok}
    left = p.near_copies_stage(spark, docs, folder)
    assert left.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    groups = brute_groups(texts, 80, 5)
    assert {r.doc_id for r in left.collect()} == {k for k, (n, low) in groups.items() if k == low or not n}
    rows = p.run(spark, folder)
    assert {"doc_id", "batch", "n_tokens"} <= set(rows.columns)
    final = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert final and final <= kept
    held = [words_of(r.text) for r in table(spark, folder, "benchmark").collect()]
    assert not any(t in words_of(texts[k]) for k in final for t in held)


def test_pipeline_stages_take_odd_rows(spark, odd, none, folder):
    import corpus_pipeline as p

    clashing = odd.withColumns({c: F.lit(c) for c in ("__row", "__HITS", "top_tail", "expected_grade", "__kept", "base_failed", "cell")})
    for name, stage in p.STAGES[:-1]:
        left = stage(spark, clashing, folder)
        assert left.columns == clashing.columns, name
        assert all(r["__row"] == "__row" and r["kept"] == "no" for r in left.collect()), name
        assert stage(spark, clashing.limit(0), folder).count() == 0, name
    assert p.packing_stage(spark, clashing, folder).count() == 7 + 30_000 // 2048 + 1
    # fewer than five words are one shingle: the two rows of id 1 and the one in capitals are copies
    left = p.near_copies_stage(spark, odd, folder)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 2, 3, 4, 5]


def test_pipeline_links_five_words_at_80_percent(spark, folder):
    import corpus_pipeline as p

    docs = table(spark, folder, "documents")
    groups = brute_groups({r.doc_id: r.text for r in docs.collect()}, 80, 5)
    left = {r.doc_id for r in dict(p.STAGES)["n-gram Jaccard join"](spark, docs, folder).collect()}
    assert left == {k for k, (n, low) in groups.items() if k == low or not n}
    assert len(left) == 187  # 189 at three words and 0.9


def test_of_copies_without_id_one_stays(spark, folder):
    import corpus_pipeline as p

    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "h i j k l m n"), (None, "h i j k l m n"), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = p.near_copies_stage(spark, docs, folder).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, ""), (0, ""), (0, "a b c d e f g"), (7, "h i j k l m n")]
