"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Language ID drops documents without an identifiable language, line dedup rewrites the texts,
near-duplicate detection leaves one document of each class, suffix dedup rewrites the texts
again, and packing returns token sequences. n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, line_dedup, near_dup, packing, suffix_dedup
from tidemark.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (not ``und``).

    Null texts and texts without a letter go; repeated rows and rows without an id are judged
    like any others; an empty table stays empty.
    """
    return langid.identified(docs, langid.fit(langid.training_rows(docs)))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in a document of larger id."""
    return line_dedup.rewritten(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class.

    Rows with equal ids and different texts are different documents; of equal rows one stays,
    and one of a class without any id. Texts that line dedup has emptied are no copies and stay.
    """
    return near_dup.firsts(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that documents of smaller id have."""
    return suffix_dedup.rewritten(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; an empty text is its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can't state the probabilistic stages; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
