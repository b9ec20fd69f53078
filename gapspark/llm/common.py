"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.session import fresh_path

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that were running, not the
    work before. The files also give the planner real sizes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks behind it until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def open_fs(uri: str):
    """File system and path of a folder or file that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, parts) -> str:
    """Write bytes under a name of this attempt; the caller commits it by listing it.

    A repeated or speculative task writes a file of its own. What no manifest
    lists is never read.
    """
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{unique}") as out:
        for part in parts:
            out.write(part)
    return unique


def lower_ascii(column):
    """A-Z in lower case, all else as it is; null gives the empty text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(column, F.lit("")), upper, upper.lower())


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Stores of words that operators keep in a Python worker from task to task.
MEMOS: list[dict] = []


def memo_of_task(memo: dict | None) -> None:
    """Names the store that a task goes on with, or none. A worker runs the tasks of one operator after
    those of another: what the others stored there is dropped, so that a worker holds one
    full store, however many operators a pipeline has."""
    if memo is not None and not any(memo is other for other in MEMOS):
        MEMOS.append(memo)
    for other in MEMOS:
        if other is not memo:
            other.clear()
