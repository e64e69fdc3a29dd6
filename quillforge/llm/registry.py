"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def oracles() -> None:
    from quillforge.llm import chat_format, jaccard_join, license_scan, line_dedup, quality_rules, source_mix

    ORACLES["op1_quality_rules"] = quality_rules.oracle()
    ORACLES["op2_source_mix"] = source_mix.oracle()
    ORACLES["op10_license_scan"] = license_scan.oracle()
    ORACLES["op6_chat_format"] = chat_format.oracle()
    ORACLES["op9_jaccard_join"] = jaccard_join.oracle()
    ORACLES["op7_line_dedup"] = line_dedup.oracle()


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.source_mix import source_mix

    return source_mix(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillforge.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillforge.llm.chat_format import chat_format, digests

    return digests(chat_format(table(spark, sf_dir, "conversations")))


oracles()
