"""The registered corpus queries and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, conversations, html_text, langid, line_dedup, mixing, near_dup, packing, phrases, quality, suffix_dedup, telephony, warc
from tidemark.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents")))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = telephony.encode_decoded(_table(spark, sf_dir, "documents"))
    return telephony.media_features(stored(media, "media", level=6, page=2 << 20))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.round_trip(_table(spark, sf_dir, "pages")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(_table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dup": op4_near_dup,
    "op5_html_text": op5_html_text,
    "op6_telephony": op6_telephony,
    "op7_bpe": op7_bpe,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_phrases": op12_phrases,
    "op13_mixing": op13_mixing,
}

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_repair": conversations.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_mixing": mixing.ORACLE,
}
