"""Corpus pipeline: each stage works on all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gullwatch.llm import decontaminate, language, minhash, packing, secrets
from gullwatch.llm.common import crc32_fold, kept_table, read_table, settings
from gullwatch.session import scratch_path

#: SQL cannot express language ID and packing; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None

#: Least share of words in the predicted language.
LEAST_SHARE = 0.3
#: Percent of shared five-word shingles from which documents are near duplicates.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds a fair share of their words, go."""
    settings(spark)
    return language.accept(docs, language.train(docs, crc32_fold(F.col("doc_id"), 5) != 0), LEAST_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group stays."""
    settings(spark)
    return minhash.deduplicate(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents holding a benchmark window go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is masked; all documents stay."""
    return secrets.redact(docs, scratch_path(spark, "blob-ledger"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 tokens."""
    settings(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), name)
    return docs
