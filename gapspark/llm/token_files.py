"""Token ids in files coded by a range asymmetric numeral system."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapspark.llm import rans
from gapspark.llm.chunk_store import store
from gapspark.llm.common import open_fs, stored, write_file
from gapspark.llm.token_counts import groups
from gapspark.session import fresh_path

#: Ids after which a writer closes its file: bounds a task's memory on either side.
FILE_IDS = 3_000_000
#: Files that one reading task decodes, one after the other.
FILES_PER_TASK = 4
#: Reading tasks at most; beyond that each decodes more files.
MOST_TASKS = 20_000
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


def encode_texts(texts: list[str], path: str, end_id: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Group by group the ids of the texts end to end, and how many each text has.

    Each new chunk goes through the library once; no pre-token crosses a chunk, so
    the chunks' ids end to end are the text's ids.
    """
    kept = store(path, end_id)
    for group in groups(texts):
        yield kept.texts(group)


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode all texts into files below ``folder``, in ascending key order.

    Returns the manifest, one row per file: part, seq (their order is the key
    order), file, n_docs, n_ids. The files come from one range shuffle on the key,
    with the text's hash as tie-break, so rows that share a key are split too. Each
    file holds a frequency table, blocks, checkpoints, checksums and the documents'
    keys and sizes. Null texts are empty (only the end id); a null key is kept as
    null and sorts first; equal keys are ordered by text; an empty table gives no file.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(F.col("key").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie", "text")
        .select("key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        keys: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        size = seq = 0
        done = []

        def flush():
            nonlocal seq, size
            if not keys:
                return
            ids = np.concatenate(parts)
            coded = rans.encode(ids) if len(ids) else empty()
            extra = {
                "keys": np.array([0 if k is None else k for k in keys], dtype="<i8"),
                "nulls": np.array([k is None for k in keys], dtype="u1"),
                "lengths": np.array(lengths, dtype="<i8"),
            }
            name = write_file(folder, f"ids-{part:06d}-{seq:04d}", rans.dump(coded, extra))
            done.append((part, seq, name, len(keys), len(ids)))
            for held in (keys, lengths, parts):
                held.clear()
            seq, size = seq + 1, 0

        for batch in batches:
            own = iter(batch.column(0).to_pylist())
            for ids, sizes in encode_texts(batch.column(1).to_pylist(), tokenizer, end_id):
                begin = end = 0
                for n in sizes.tolist():
                    keys.append(next(own))
                    lengths.append(n)
                    size, end = size + n, end + n
                    if size >= FILE_IDS:
                        parts.append(ids[begin:end])
                        begin = end
                        flush()
                parts.append(ids[begin:])
        flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
            names=["part", "seq", "file", "n_docs", "n_ids"],
        )

    manifest = ordered.mapInArrow(run, MANIFEST)
    return stored(manifest, "id-manifest")


def empty() -> rans.Encoded:
    return rans.Encoded(
        np.zeros(0, np.uint32), np.zeros(0, np.uint32), 0, 0, 1, np.zeros((0, 0, rans.LANES), np.uint64),
        np.zeros((0, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32),
    )


def read_file(folder: str, name: str):
    """Keys, id counts and ids of one file, checked against its checksums."""
    system, path = open_fs(folder)
    with system.open_input_stream(f"{path}/{name}") as stream:
        coded, extra = rans.load(stream.read())
    ids = rans.decode(coded) if coded.n else np.zeros(0, np.uint32)
    keys = [None if null else int(k) for k, null in zip(extra["keys"], extra["nulls"], strict=True)]
    return keys, extra["lengths"], ids


def read_ids(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Read the files a manifest lists: key, start, n_ids, crc32 and, if asked, ids.

    ``start`` is the number of ids of all documents before. Only one row per writing
    task is summed over the whole table; files are decoded side by side.
    """
    # one row per writing task is summed in order, then the files of each task apart
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    own = Window.partitionBy("part").orderBy("seq")
    base = F.col("part_base") + F.sum("n_ids").over(own) - F.col("n_ids")
    files = manifest.join(parts, "part").select("file", base.cast("long").alias("base"))
    # a partition to a few files; a plain exchange would be coalesced by its few bytes
    files = files.repartition(min(MOST_TASKS, -(-manifest.count() // FILES_PER_TASK) or 1))
    schema = "key long, start long, n_ids long, crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, lengths, ids = read_file(folder, name)
                ends = np.cumsum(lengths)
                raw = np.ascontiguousarray(ids, dtype="<u4")
                sums = [zlib.crc32(raw[e - n : e]) for n, e in zip(lengths, ends, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(base + ends - lengths, pa.int64()),
                           pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["key", "start", "n_ids", "crc32"]
                if with_ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, schema)


def id_digests(spark: SparkSession, df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents, read them back, one row per document."""
    folder = fresh_path(spark, "token-ids")
    manifest = write_ids(df, folder, tokenizer, end_id)
    back = read_ids(manifest, folder, with_ids=False)
    return back.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.col("crc32").alias("ids_crc32")
    )
