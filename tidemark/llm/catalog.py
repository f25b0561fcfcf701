"""Registered corpus queries: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, decontaminate, language, licences, line_dedup, ngram_jaccard, pieces, quality, token_counts, warc
from tidemark.runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicate_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_dedup": op3_line_dedup,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_licences": op8_licences,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_id": op10_language_id,
}

#: DuckDB equivalents, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": ngram_jaccard.oracle_sql(n=4, num=85, den=100),
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op5_quality_rules": quality.oracle_sql(),
    "op6_decontamination": decontaminate.oracle_sql(),
    "op7_chat": chat.ORACLE_SQL,
    "op8_licences": licences.oracle_sql(),
}
