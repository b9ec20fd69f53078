"""A corpus pipeline: quality rules, quality model, near duplicates, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapspark.llm import decontaminate, jaccard, packing, quality_model, quality_rules
from gapspark.llm.common import stored, table, unused


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of their own, so that rows which share an id, or have
    none, are decided one by one, and the number's name, which no column of theirs has.
    The numbers are fixed before they are used."""
    row = unused(docs, "__row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their distance reject go.

    Null and empty texts have too few words and go; rows that share an id are judged one
    by one; an empty table stays empty; columns of any name stay.
    """
    rows, row = numbered(docs)
    kept = quality_rules.quality_rules(rows, key=row).where("kept").select(row)
    return rows.join(kept, row, "left_semi").select(docs.columns)


def quality_model_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is below one half go. The model is
    fitted on the rated documents, those that an earlier stage took among them.

    Null and empty texts have no features, so the shares of the grades alone decide; rows
    are judged one by one; an empty table stays empty; columns of any name stay.
    """
    ratings = quality_model.graded(table(spark, sf_dir, "labels"))
    model = quality_model.train(table(spark, sf_dir, "documents"), ratings, grades=3)
    result = tuple(unused(docs, f"__{name}") for name in quality_model.RESULT)
    judged = quality_model.apply(docs, model, keep=None, result=result)
    return judged.where(result[2]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates as the pipeline links them: five words, a similarity of 0.8 or more. Of each group of linked documents the one with the smallest id stays; of rows with
    that id and set, one; rows without id come last. Documents without text are nobody's copy."""
    rows, row = numbered(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    groups = jaccard.jaccard_groups(rows, n=5, percent=80, key=row).withColumnRenamed("component_id", "group")
    tied = groups.where("n_shingles > 0").join(rows.select(row, "doc_id"), row)
    first = tied.groupBy("group").agg(F.min(order).alias("first")).select(F.col(f"first.{row}").alias(row))
    others = stored(tied.select(row).join(first, row, "left_anti"), "pipeline-copies")
    return rows.join(others, row, "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of what is left, as ``packing.pack`` states them for null, empty and long texts."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_model_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained and iterative stages have no SQL; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
