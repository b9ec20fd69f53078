"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gapspark.llm import bpe


@lru_cache(maxsize=2)
def engine(path: str) -> tuple[bpe.Merges, bpe.Memo]:
    return bpe.Merges(path), bpe.Memo()


#: Texts whose new pre-tokens are merged together.
GROUP_CHARS = 2_000_000


def groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_tokens(texts: list[str], path: str, pattern: str) -> list[int]:
    """Tokens of each text, special strings inside it counted as one token each."""
    merges, memo = engine(path)
    split = bpe.splitter(pattern)

    def compute(chunks: list[str]) -> list[int]:
        return merges.counts_in([split(c) for c in chunks])

    memo[None] = 1
    out: list[int] = []
    for group in groups(texts):
        out += map(sum, memo.lookup(list(bpe.chunks_of(group, merges.specials)), compute))
    return out


def token_counts(
    df: DataFrame, tokenizer: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    limit: int = 1024,
) -> DataFrame:
    """One row per input row: the ``keep`` columns, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is a byte-level BPE file, ``pattern`` the expression that cuts
    texts into pre-tokens. Null and empty texts have 0 bytes and 0 tokens. Texts are
    never cut; repeated rows and null ids are counted like any other row; an empty
    table gives no row. Columns outside ``keep`` are not read. Runs row-local: no
    shuffle, and memory is bounded by one Arrow batch and the pre-token store.
    """
    kept = df.select(*[F.col(f"`{k}`") for k in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = StructType([*kept.schema.fields[:-1], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = [len(t.encode("utf-8")) for t in texts]
            counts = count_tokens(texts, tokenizer, pattern)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=names
            )

    return kept.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
