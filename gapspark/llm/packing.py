"""Packing: optimal length buckets, and batches of a token budget inside each.

The histogram of piece lengths (at most ``max_len`` bins) goes to the driver, where
dynamic programming finds the bucket boundaries of least padding. Rows never do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapspark.llm.common import stored

#: Rows that are numbered in one sorted group.
SLOT_ROWS = 50_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend and are distinct. best[j] is the least padding of the first j
    lengths with the buckets used so far; a bucket (i, j] costs
    lengths[j-1] * rows - tokens. Ties take the smaller start.
    """
    m = len(lengths)
    if m <= buckets:
        return [int(x) for x in lengths]
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    ends = np.arange(1, m + 1)
    # cost[i, j-1] of the bucket that holds lengths i .. j-1
    cost = lengths[None, :] * (rows[ends][None, :] - rows[:m, None]) - (tokens[ends][None, :] - tokens[:m, None])
    cost = np.where(np.arange(m)[:, None] < ends[None, :], cost, np.iinfo(np.int64).max // 4)
    best, froms = cost[0].copy(), []
    for _ in range(1, buckets):
        through = np.concatenate([[0], best[:-1]])[:, None] + cost
        start = np.argmin(through, axis=0)
        froms.append(start)
        best = through[start, np.arange(m)]
    bounds, j = [], m
    for start in reversed(froms):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(start[j - 1])
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(set(bounds))


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def pack(
    df: DataFrame, length: Column | None = None, key: str = "doc_id", text: str = "text", max_len: int = 2048,
    buckets: int = 8, budget: int = 65_536,
) -> DataFrame:
    """One row per piece: key, piece, start, n_tokens, bucket, padded, batch, slot_in_batch.

    ``length`` gives a row's tokens (words of ``text`` by default). A row longer than
    ``max_len`` becomes pieces of ``max_len`` and a rest; nothing is dropped. Rows
    without tokens (null, empty) are one piece of length 0 in the first bucket.
    ``bucket`` is the padded length's place among the boundaries, a batch holds
    budget // padded pieces of one bucket (one at least) and is numbered inside it.
    Pieces are ordered by key, start and length; rows with the same key are packed each;
    null keys come first; an empty table gives no row.

    Numbering needs no global sort: pieces fall into slots by a hash, are numbered inside
    (bucket, slot), and the slots' sizes are summed up per bucket. A hot key or bucket is
    therefore spread over as many slots as its rows need.
    """
    if budget < max_len:
        raise ValueError("a batch must have room for one piece of the greatest length")
    size = F.coalesce(word_count(F.col(f"`{text}`")) if length is None else length, F.lit(0)).cast("long")
    rows = df.select(F.col(f"`{key}`").alias("key"), F.greatest(size, F.lit(0)).alias("size"))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / max_len) - 1).cast("int")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * max_len)
    pieces = pieces.select("key", "piece", "start", F.least(F.col("size") - F.col("start"), F.lit(max_len)).alias("n_tokens"))
    pieces = stored(pieces, "pieces")
    found = pieces.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # max_len + 1 rows at most
    lengths, counts = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.int64)
    bounds = optimal_boundaries(lengths, counts, buckets) if found else [max_len]
    bucket, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        inside = F.col("n_tokens") <= bounds[i]
        bucket, padded = F.when(inside, i).otherwise(bucket), F.when(inside, bounds[i]).otherwise(padded)
    slots = max(1, -(-int(counts.sum() if found else 0) // SLOT_ROWS))
    placed = pieces.select(
        "*", bucket.cast("int").alias("bucket"), padded.cast("long").alias("padded"),
        F.pmod(F.xxhash64("key", "piece", "n_tokens"), F.lit(slots)).cast("int").alias("slot"),
    )
    sizes = placed.groupBy("bucket", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("bucket", "slot").orderBy(F.col("key").asc_nulls_first(), "start", "n_tokens")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["bucket", "slot"])
    rank, room = F.col("rank") + F.col("offset"), F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1))))
    return numbered.select(
        F.col("key").alias(key), "piece", "start", "n_tokens", "bucket", "padded",
        F.floor(rank / room).cast("long").alias("batch"), (rank % room).cast("long").alias("slot_in_batch"),
    )
