"""Session set-up and the shared folder for checkpoints and stream state."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
LOCAL_SESSION_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def build_session(
    app: str = "gapspark", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings the operators count on.

    AQE coalesces small shuffle partitions, splits skewed join partitions and
    turns a join into a broadcast once the measured size is below the threshold;
    no operator hints a broadcast of a table whose size is not fixed.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(LOCAL_SESSION_MERGE, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    There is no other: entry points, tests and the bench name one too.
    """
    named = spark.conf.get(CHECKPOINT_CONF, "") or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(spark: SparkSession, df):
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df, name: str):
    """A frame written below the shared folder and read back: the lineage is cut and the
    planner knows its size, so a small table is broadcast by its measured bytes."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text that a task takes where the words of its texts become rows.
TEXT_PART = 4 << 20


def spread(df, content: str, key: str, name: str):
    """A frame of texts, written and dealt out by a key, a few MB of text to a partition:
    so what a task holds of their words does not grow with the table. The number is fixed
    by the bytes of all texts, since words as rows are many times the shuffled text."""
    texts = written(df, name)
    size = texts.agg(F.sum(F.octet_length(content))).first()[0] or 0
    few = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // (64 << 10)))
    return texts.repartition(max(1, few, -(-size // TEXT_PART)), key)


@contextmanager
def bucketed(df, key: str, name: str, buckets: int | None = None):
    """A frame written in buckets of a key, as a table for the length of a block.

    Aggregates, windows and joins by the key then need no exchange, however often the
    table is read. The files stay below the shared folder, only the name goes.
    """
    spark = df.sparkSession
    table = f"gapspark_{name}_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", fresh_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
