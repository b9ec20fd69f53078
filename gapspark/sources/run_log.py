"""Resumable runs: which landing partitions were taken, and the rows they gave.

A run writes its rows into a folder of its own number and is committed by a manifest of
the partitions it took, written last. A partition in a committed manifest is not read
again; the rows of a run that broke before its commit are not seen and are written over
when the run is repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.sources import folders


class RunLog:
    def __init__(self, spark: SparkSession, folder: str, column: str):
        """``column`` is the partition column of the landing table."""
        self.spark, self.folder, self.column = spark, folder, column

    def runs(self) -> list[int]:
        return folders.finished(self.spark, f"{self.folder}/manifest", "run")

    def taken(self) -> DataFrame | None:
        """The partitions of all committed runs, with their run and number of rows."""
        parts = [
            self.spark.read.parquet(f"{self.folder}/manifest/run={n}").withColumn("run", F.lit(n)) for n in self.runs()
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def rows(self) -> DataFrame | None:
        """The rows of all committed runs."""
        parts = [self.spark.read.parquet(f"{self.folder}/rows/run={n}") for n in self.runs()]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def run(self, landing: DataFrame, work: Callable[[DataFrame], DataFrame], upto=None) -> int | None:
        """Work on the partitions nobody took (those up to ``upto``), write, commit.

        Partition names are few: they are listed on the driver and prune the read, so
        nothing of a taken partition is opened. ``work`` keeps the partition column.
        Returns the number of the run; None when nothing was left. A NULL partition is
        one like any other.
        """
        known = self.taken()
        names = landing.select(self.column).distinct()
        if upto is not None:
            names = names.where(F.col(self.column) <= upto)
        if known is not None:
            same = F.col(self.column).eqNullSafe(F.col("_taken"))
            names = names.join(known.select(F.col(self.column).alias("_taken")), same, "left_anti")
        fresh = [r[0] for r in names.collect()]
        if not fresh:
            return None
        number = (self.runs() or [-1])[-1] + 1
        wanted = F.col(self.column).isin([n for n in fresh if n is not None])
        if None in fresh:
            wanted = wanted | F.col(self.column).isNull()
        target = f"{self.folder}/rows/run={number}"
        work(landing.where(wanted)).write.mode("overwrite").parquet(target)
        counts = self.spark.read.parquet(target).groupBy(self.column).agg(F.count("*").alias("rows"))
        listed = self.spark.createDataFrame([(n,) for n in fresh], landing.select(self.column).schema)
        manifest = listed.alias("l").join(counts.alias("c"), F.col(f"l.{self.column}").eqNullSafe(F.col(f"c.{self.column}")), "left")
        manifest = manifest.select(f"l.{self.column}", F.coalesce("rows", F.lit(0)).alias("rows"))
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/run={number}")
        return number
