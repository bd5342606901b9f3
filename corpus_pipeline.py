"""A training-corpus pipeline of the operators in ``tributary.llm``: see ``STAGES``.

Every stage works on the whole table that the one before it kept; all but the last return
the columns of ``documents``; the last one returns ids for each document it was given.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, line_dedup, mixing, near_dedup, quality
from tributary.llm.common import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Shared tables of the stage called last.
_tables: list[Scratch] = []


def stage(function):
    """A stage whose rows are written before the next one is called; then its shared tables go."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for table in _tables:
            table.clear()
        before = list(Scratch.live)
        out = function(spark, docs, sf_dir)
        _tables[:] = [t for t in Scratch.live if t not in before]
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality.quality_filter(docs)


@stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occur before in the corpus are taken out of the texts."""
    return line_dedup.dedup_lines(docs)


@stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.deduplicate(docs)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@stage
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, its ids and the digest of the bytes they decode to."""
    return bpe.encoded_documents(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]
#: Random rounding in the mix cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
