"""Exact Jaccard join of n-gram sets through prefix trees, and the groups it links.

Sets are in one global order, rarest first. Two sets that link share one of their first
elements (prefix filter) at places that leave room for the rest (position filter). The
documents that share such an element form a task: the sets of its members are put in a
trie, and a query set walks it, sharing the overlap of common beginnings and leaving a
subtree when what remains is too short for a link.

Short lists of documents that share an element give pairs; a document is compared with its
first partner, and then with those of its partners that are in another component. In a long list (many
near copies) every member is first compared with one of them; only components are asked
for, so a list whose members are then in one component is done. Parity sketches rule out
most pairs that only share common elements before their sets are fetched. The other long lists
are compared in full, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gapspark.llm.common import ASCII_LOWER, memo_of_task, stored

WORDS = re.compile(r"[^ \t-\r]+").findall
#: Counters of the frequency sketch, which sets the global order.
BUCKETS = 1 << 18
#: Members of one trie at most.
BLOCK = 256
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Codes(dict):
    """64-bit codes by word, A-Z in lower case; new ones are not kept once it is full."""

    def __missing__(self, word: str) -> int:
        lower = word.translate(ASCII_LOWER).encode("utf-8", "surrogatepass")
        code = int.from_bytes(hashlib.blake2b(lower, digest_size=8).digest(), "little")
        if len(self) < 500_000:
            self[word] = code
        return code


CODES = Codes()


def begin_task() -> None:
    memo_of_task(CODES)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int) -> np.ndarray:
    """Distinct 64-bit codes of a text's n-word shingles, ascending."""
    words = WORDS(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    c = np.fromiter(map(CODES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(c))
    count = len(c) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(count, np.uint64(width))
        for i in range(width):
            out = mixed(out * MIX[0] + c[i : i + count])
    return np.unique(out)


def least_overlap(a, b, t: int):
    """Shared elements that two sets of these sizes need: 100 i >= t (a + b - i)."""
    return -(-(t * (a + b)) // (100 + t))


def prefix_size(size: int, t: int) -> int:
    """Elements of which one is shared with any set of the same size or more that links."""
    return size - (-(-(t * size) // 100)) + 1


def frequency_order(df: DataFrame, n: int) -> np.ndarray:
    """A class for each bucket of shingle codes: finer than octaves of the documents that hold it.

    Each task counts its documents' shingles per bucket; the counts add up by bucket. The
    table has BUCKETS rows whatever the input, one byte each when it is sent out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                codes = np.concatenate([shingles(x, n) for x in texts[at : at + 200]])
                seen += np.bincount((codes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(seen[held])], names=["bucket", "n"])

    counted = df.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    total = np.zeros(BUCKETS)
    total[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)


def ordered(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Codes in the global order, by frequency class and then by code, as sortable keys."""
    top = classes[(codes % np.uint64(BUCKETS)).astype(np.int64)].astype(np.uint64)
    return np.sort((top << np.uint64(56)) | (codes >> np.uint64(8)))


#: Bits of a set's parity sketch at least; a larger set has a bit for two elements or more,
#: always a power of two: with few bits, large sets that share little could not be told apart.
SKETCH = 1024


def parity_sketch(keys: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of keys falls on it.

    An element that one of two sets holds alone changes one bit at most, so sketches
    that differ in d bits prove that at least d elements are not shared. The exclusive or
    of the halves of a sketch is the set's sketch of half as many bits.
    """
    bits = max(SKETCH, 1 << ((len(keys) + 1) // 2 - 1).bit_length() if len(keys) else 0)
    mixed_keys = mixed(keys)
    odd = np.bincount((mixed_keys % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: str, words):
    """A sketch as one of so many words, its own number or a smaller power of two."""
    parts = F.sequence(F.lit(0), (F.size(sketch) / words).cast("int") - 1)
    part = lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(sketch, i + j * words)))
    return F.when(F.size(sketch) == words, F.col(sketch)).otherwise(F.transform(F.sequence(F.lit(0), words - 1), part))


def signatures(df: DataFrame, classes: np.ndarray, n: int, t: int) -> DataFrame:
    """id, size, digest (of the whole set), prefix (keys as signed numbers), sketch."""
    shared = df.sparkSession.sparkContext.broadcast(classes)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            sizes, digests, prefixes, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                keys = ordered(shingles(text, n), shared.value)
                sizes.append(len(keys))
                sketches.append(parity_sketch(keys))
                digests.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest())
                prefixes.append(keys[: prefix_size(len(keys), t)].view(np.int64) if len(keys) else keys.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "size", "digest", "prefix", "sketch"],
            )

    schema = StructType([*df.select("id").schema.fields, *StructType.fromDDL("size long, digest binary, prefix array<long>, sketch array<long>").fields])
    return df.select("id", "text").mapInArrow(run, schema)


def sets_of(df: DataFrame, classes: np.ndarray, n: int) -> DataFrame:
    """id, keys: whole ordered sets, as bytes."""
    shared = df.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            keys = [ordered(shingles(x, n), shared.value).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["id", "keys"])

    schema = StructType([*df.select("id").schema.fields, *StructType.fromDDL("keys binary").fields])
    return df.select("id", "text").mapInArrow(run, schema)


class Trie:
    """A prefix tree over ordered sets, as its leaves in order.

    The sets lie in lexicographic order; ``common[i]`` is how long a beginning set i
    shares with set i - 1, which is where it leaves that set's path. A subtree below
    depth d is a run of sets with ``common`` >= d after its first.
    """

    def __init__(self, sets: list[np.ndarray]):
        # big-endian bytes compare as the ordered keys do
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.common = [0] * len(sets)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = int(differ[0]) if len(differ) else m
        self.branch = np.array(self.common, dtype=np.int64)
        sizes = [len(s) for s in self.sets]
        self.least, self.most = min(sizes, default=0), max(sizes, default=0)
        self.visited = 0

    def run_end(self, i: int, depth: int) -> int:
        """The leaf after the subtree below ``depth`` that leaf i lies in."""
        leaves = np.flatnonzero(self.branch[i + 1 :] < depth)
        return i + 1 + int(leaves[0]) if len(leaves) else len(self.sets)

    def links(self, query: np.ndarray, t: int, wanted) -> list[int]:
        """Members that link to the query; ``wanted(i)`` says whether member i is of interest.

        Walks the leaves in order. Along a path, ``shared[d]`` is the overlap of its first
        d elements with the query and ``passed[d]`` the query elements before them; both
        are kept from the path before up to the branch. The overlap of any set below depth
        d is at most shared + min(rest of the longest path, rest of the query), and the
        shortest set needs the least: where that bound fails, the walk goes on behind the
        subtree. ``visited`` counts the leaves whose path was looked at.
        """
        out = []
        q = len(query)
        if not len(self.sets) or not q:
            return out
        shared, passed = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        at = 0  # depth to which shared and passed hold for the current path
        least = least_overlap(self.least, q, t)
        i = 0
        while i < len(self.sets):
            keys = self.sets[i]
            at = min(at, self.common[i])
            size = len(keys)
            if not wanted(self.order[i]):
                i += 1
                continue
            need = least_overlap(size, q, t)
            if shared[at] + min(size - at, q - passed[at]) < need or min(size, q) < need:
                i += 1  # this leaf's own size rules it out
                continue
            self.visited += 1
            tail = keys[at:]
            place = np.searchsorted(query, tail)
            hit = query[np.minimum(place, q - 1)] == tail
            shared = np.concatenate([shared[: at + 1], shared[at] + np.cumsum(hit)])
            passed = np.concatenate([passed[: at + 1], place + hit])
            at = size
            if shared[size] >= need:
                out.append(self.order[i])
                i += 1
                continue
            i += 1
            # the bound only falls along a path: where it holds at the branch to the next
            # leaf it holds above, and else its first failure has the largest subtree
            d = self.common[i] if i < len(self.sets) else 0
            if d and shared[d] + min(self.most - d, q - passed[d]) < least:
                bound = shared[: d + 1] + np.minimum(self.most - np.arange(d + 1), q - passed[: d + 1])
                i = self.run_end(i - 1, int(np.flatnonzero(bound < least)[0]))
        return out


def task_links(rows: list[tuple], t: int) -> list[tuple]:
    """Links of one task. ``rows``: id, component, is_query, is_member, keys.

    A pair in one component already is not compared; pairs found join their components
    within the task.
    """
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    members = [i for i, r in enumerate(rows) if r[3]]
    if not members:
        return []
    trie = Trie([sets[i] for i in members])
    parent: dict = {}

    def root(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, r in enumerate(rows):
        if not r[2] or not len(sets[i]):
            continue
        mine = root(r[1])
        other = [root(rows[j][1]) != mine for j in members]
        if not any(other):
            continue
        for m in trie.links(sets[i], t, other.__getitem__):
            j = members[m]
            a, b = root(r[1]), root(rows[j][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((r[0], rows[j][0]))
    return out


def run_tasks(tasks: DataFrame, sets: DataFrame, components: DataFrame, t: int) -> DataFrame:
    """Links (a, b) of tasks (task, id, is_query, is_member)."""
    tasks = stored(tasks, "jaccard-tasks")
    own = sets.join(tasks.select("id").distinct(), "id", "left_semi")  # few ids: the other sets do not travel
    full = tasks.join(components, "id").join(own, "id").select("task", "id", "component", "is_query", "is_member", "keys")
    kinds = dict(full.dtypes)

    def run(table: pa.Table) -> pa.Table:
        names = ("id", "component", "is_query", "is_member", "keys")
        rows = sorted(zip(*[table[c].to_pylist() for c in names], strict=True), key=lambda r: r[0])
        found = task_links(rows, t)
        return pa.table({"a": pa.array([x for x, _ in found], table["id"].type), "b": pa.array([y for _, y in found], table["id"].type)})

    return full.groupBy("task").applyInArrow(run, f"a {kinds['id']}, b {kinds['id']}")


def connected(ids: DataFrame, links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """id, component (smallest id reachable) of ``ids`` under ``links`` (a, b).

    Every round each component takes the smallest component among its neighbours, and
    then the component of that; the links between components that are left are carried
    on. The table of labels is small: ids are those with a candidate.
    """
    labels = ids.select("id", F.col("id").alias("component")) if before is None else before
    start = labels.select("id", F.col("component").alias("c"))
    edges = links.join(start.withColumnsRenamed({"id": "a", "c": "x"}), "a").join(start.withColumnsRenamed({"id": "b", "c": "y"}), "b")
    edges = stored(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    moved = None
    while edges.head(1):
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = stored(both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("c"), F.least("x", "low").alias("to")), "steps")
        # two jumps: the target's own target is smaller still
        far = step.select(F.col("c").alias("to"), F.col("to").alias("further"))
        step = stored(step.join(far, "to", "left").select("c", F.coalesce("further", "to").alias("to")), "steps")
        if moved is None:
            moved = step
        else:
            onward = step.select(F.col("c").alias("to"), F.col("to").alias("further"))
            kept = moved.join(onward, "to", "left").select("c", F.coalesce("further", "to").alias("to"))
            moved = stored(kept.union(step.join(moved, "c", "left_anti")), "moved")
        a, b = step.withColumnsRenamed({"c": "x", "to": "tx"}), step.withColumnsRenamed({"c": "y", "to": "ty"})
        edges = edges.join(a, "x").join(b, "y").where("tx <> ty")
        edges = stored(edges.select(F.least("tx", "ty").alias("x"), F.greatest("tx", "ty").alias("y")).distinct(), "edges")
    if moved is None:
        return labels
    return stored(
        labels.withColumnRenamed("component", "c").join(moved, "c", "left").select("id", F.coalesce("to", "c").alias("component")), "components"
    )


def dealt(lists: DataFrame, name: str, block: int) -> DataFrame:
    """``blocks`` (how many a list needs) and ``own`` (a member's block) for (name, id)."""
    sizes = lists.groupBy(name).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return lists.join(sizes, name).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))


def blocks_of_tasks(lists: DataFrame, block: int) -> DataFrame:
    """Tasks (task, id, is_query, is_member) that compare all members of each list.

    ``lists`` has list, id. A list of up to ``block`` members is one task; a longer one is
    dealt into blocks, and every pair of blocks is a task.
    """
    pairs = dealt(lists, "list", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return pairs.select(
        F.concat_ws("/", F.col("list").cast("string"), low, high).alias("task"), "id",
        (F.col("own") == low).alias("is_query"), (F.col("own") == high).alias("is_member"),
    )


def need(a, b, percent: int):
    """Shared elements that sets of these sizes need, as columns."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def jaccard_groups(
    df: DataFrame, n: int = 3, percent: int = 90, text: str = "text", key: str = "doc_id", block: int = BLOCK,
    small: int = 64,
) -> DataFrame:
    """One row per row: key, n_shingles, component_id (smallest key reachable by links).

    Rows link when 100 * shared >= percent * union of their distinct n-word shingles; with
    fewer words the whole sequence is one shingle. Null and empty texts have no shingle and
    link with nothing. Equal sets are one class, represented by its smallest key, so copies
    cost one row each. Rows with the same key stay rows of their own, each in the component
    of its own set; a key that represents several sets joins them. Null keys link with
    nothing and have a null component. An empty table gives no row. Whole texts are read;
    sets are compared by 56-bit codes, without any other approximation.
    """
    docs = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    classes = frequency_order(docs, n)
    marked = stored(signatures(docs, classes, n, percent), "jaccard-signatures")
    held = marked.where("id IS NOT NULL AND size > 0")
    owners = stored(held.groupBy("size", "digest").agg(F.min("id").alias("rep")), "jaccard-classes")
    # a repeated key may represent several classes; a class is named by (rep, size, digest)
    chosen = held.join(owners.withColumnRenamed("rep", "id"), ["size", "digest", "id"], "left_semi")
    chosen = stored(chosen.dropDuplicates(["size", "digest", "id"]).select("id", "size", "prefix", "sketch"), "jaccard-prefixes")
    entries = chosen.select("id", "size", F.posexplode("prefix").alias("at", "token"))
    seen = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"))
    lists = entries.join(seen.where("n > 1"), "token")
    # a linked pair meets in the list of the first element both hold; a member needs room
    # there for a partner of the list's least size, and of at least percent of its own
    partner = F.greatest("least", F.ceil(F.lit(percent) * F.col("size") / 100))
    roomy = F.col("size") - F.col("at") >= need(F.col("size"), partner, percent)
    lists = stored(lists.where(roomy).select("token", "id", "size", "at", "n"), "jaccard-lists")
    short, long_ = lists.where(F.col("n") <= small), lists.where(F.col("n") > small)
    close = near(short_pairs(short, percent).distinct(), chosen, percent)
    pairs = stored(close.union(near(pivot_pairs(long_).distinct(), chosen, percent)).distinct(), "jaccard-pairs")
    in_long = long_.select("id")
    candidates = stored(pairs.select("id").union(pairs.select(F.col("pivot").alias("id"))).union(in_long).distinct(), "jaccard-candidates")
    sets = stored(sets_of(docs.join(candidates, "id", "left_semi"), classes, n), "jaccard-sets")
    labels = candidates.select("id", F.col("id").alias("component"))
    # a member is compared with its first pivot, then with those that are still apart from it
    links = stored(run_tasks(tasks_of_pairs(first_pivots(pairs), block), sets, labels, percent), "jaccard-links")
    labels = connected(candidates, links)
    left = stored(apart(pairs, labels), "jaccard-apart")
    if left.head(1):
        links = stored(run_tasks(tasks_of_pairs(left, block), sets, labels, percent), "jaccard-links")
        labels = connected(candidates, links, labels)
    # long lists whose members are still in several components are compared in full
    left = stored(open_lists(long_.join(labels, "id")), "jaccard-open")
    if left.head(1):
        links = stored(run_tasks(blocks_of_tasks(left, block), sets, labels, percent), "jaccard-links")
        labels = connected(candidates, links, labels)
    # a class takes its representative's component, a key the smallest of its classes
    of_class = owners.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("size", "digest", F.coalesce("component", "rep").alias("component"))
    member = marked.join(of_class, ["size", "digest"], "left")
    return member.select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (id, pivot) pairs that sizes and parity sketches do not rule out.

    A link allows (100 - percent) / (100 + percent) of both sizes as elements of one set
    alone. Of an id with several sets any may link.
    """
    a = sets.select("id", F.col("size").alias("sa"), F.col("sketch").alias("ka"))
    b = sets.select(F.col("id").alias("pivot"), F.col("size").alias("sb"), F.col("sketch").alias("kb"))
    words = F.least(F.size("ka"), F.size("kb"))
    differ = F.aggregate(
        F.zip_with(folded("ka", words), folded("kb", words), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0), lambda total, bits: total + bits,
    )
    needed = need(F.col("sa"), F.col("sb"), percent)
    fit = F.least("sa", "sb") >= needed
    allowed = F.col("sa") + F.col("sb") - 2 * needed
    return pairs.join(a, "id").join(b, "pivot").where(fit).where(differ <= allowed).select("id", "pivot").distinct()


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(id, pivot) pairs that may link, of lists of a bounded number of members."""
    a = lists.select("token", F.col("id").alias("pivot"), F.col("size").alias("sa"), F.col("at").alias("pa"))
    b = lists.select("token", "id", F.col("size").alias("sb"), F.col("at").alias("pb"))
    room = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))
    fit = (F.col("pivot") < F.col("id")) & (room >= need(F.col("sa"), F.col("sb"), percent))
    return a.join(b, "token").where(fit).select("id", "pivot")


def pivot_pairs(lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's first one: as many pairs as members."""
    first = lists.groupBy("token").agg(F.min(F.struct("size", "id")).alias("p"))
    return lists.join(first, "token").select("id", F.col("p.id").alias("pivot")).where("id <> pivot")


def first_pivots(pairs: DataFrame) -> DataFrame:
    """(id, pivot) of each id with its smallest pivot: one pair for an id."""
    return pairs.groupBy("id").agg(F.min("pivot").alias("pivot"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The (id, pivot) pairs whose ends are in different components."""
    a = labels.withColumnRenamed("component", "ca")
    b = labels.select(F.col("id").alias("pivot"), F.col("component").alias("cb"))
    return pairs.join(a, "id").join(b, "pivot").where("ca <> cb").select("id", "pivot")


def tasks_of_pairs(pairs: DataFrame, block: int) -> DataFrame:
    """Tasks whose query is a pivot and whose members are up to about ``block`` partners."""
    salted = dealt(pairs, "pivot", block)
    task = F.concat_ws("/", F.col("pivot").cast("string"), F.col("own").cast("string")).alias("task")
    queries = salted.select("pivot", "own").distinct()
    return salted.select(task, "id", F.lit(False).alias("is_query"), F.lit(True).alias("is_member")).union(
        queries.select(task, F.col("pivot").alias("id"), F.lit(True), F.lit(False))
    )


def open_lists(lists: DataFrame) -> DataFrame:
    """list, id of lists with members in several components; lists of the same members,
    named by an order-free digest of them, are one."""
    named = lists.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    )
    one = named.where("lo <> hi").groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    return lists.join(one, "token").select(F.col("token").alias("list"), "id").distinct()
