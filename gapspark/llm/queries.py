"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gapspark.llm import (
    chat_format, decontaminate, html_extract, jaccard, license_scan, packing, phrases, quality_model, quality_rules,
    ranked_search, token_counts, token_files, warc,
)
from gapspark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(spark, table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def ordinal_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_model.OrdinalModel:
    return quality_model.train(docs, quality_model.graded(table(spark, sf_dir, "labels")), grades=3)


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.apply(docs, ordinal_model(spark, docs, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.id_digests(spark, table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, BYTE_BPE, public_tokenizers.PATTERN, limit=1024)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_trial(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_log(chat_format.turn_events(turns)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": op1_license_scan,
    "op2_html_extract": op2_html_extract,
    "op3_jaccard": op3_jaccard,
    "op7_decontaminate": op7_decontaminate,
    "op9_warc": op9_warc,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op8_quality_model": op8_quality_model,
    "op6_token_files": op6_token_files,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_chat_format": op13_chat_format,
}

SQL: dict[str, str] = {
    "op1_license_scan": license_scan.oracle(),
    "op9_warc": warc.oracle(),
    "op11_collocations": phrases.oracle(),
    "op12_ranked_search": ranked_search.oracle(),
    "op13_chat_format": chat_format.oracle(),
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
