"""One query for each corpus operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, exact_dedup, html_extract, line_dedup, mixing, near_dedup, pii, quality, suffix_dedup, token_files

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_table(spark, sf_dir, "documents"), WORD_MODEL)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def queries():
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_pii": op2_pii,
        "op3_quality_rules": op3_quality_rules,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_token_files": op5_token_files,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_near_dedup": op8_near_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_html_extract": op10_html_extract,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op8_near_dedup": near_dedup.ORACLE,
        "op9_suffix_dedup": suffix_dedup.ORACLE,
    }
