"""The corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, then tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. `run` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's docs. All stages but the last return the columns of
documents. Empty tables, null columns and repeated rows pass as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, pii, queries, quality, simhash
from plumbline.llm.common import result, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier scores at 0.7 or more."""
    return quality.keep(docs, queries.quality_model(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, pii.fit(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes. The tables are small: earlier stages have filled the heap."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, most_states=100_000, most_pieces=100_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("byte-level BPE", bpe_stage),
]

#: A trained classifier and a conditional random field decide on rows; SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself goes once its result is written; results of stages stay."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = result(made, "stage-" + name.replace(" ", "-"))
    return docs
