"""A corpus pipeline of five stages: language, quality, near duplicates, decontamination, tokens.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its rows are
written as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexalloc.llm import bpe, common, decontamination, language_id, near_dups, quality

#: Stages on word shingles take five words and a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is less than even odds."""
    return language_id.keep_identified(docs, language_id.fit_documents(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or stand far from every language reference."""
    return quality.keep_good(docs, quality.fit_references(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return near_dups.keep_first(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in benchmark windows."""
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes they decode to."""
    return bpe.digest_documents(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", encode_tokens),
]

#: The learned and iterative stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage_{name}")
    return docs
