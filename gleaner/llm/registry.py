"""Queries of the training-data operators: ``QUERIES`` by name, ``ORACLES`` where DuckDB SQL expresses one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .containment import near_duplicates
from .decontamination import contaminated_pairs
from .language_id import language_id
from .packing import concat_and_cut
from .pii import replace_pii
from .quality_rules import quality_cascade
from .substring_dedup import dedup_windows
from .token_count import count_tokens
from .toxicity import toxicity_held_out
from .weak_labels import weak_label_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


PII_KEY = b"gleaner surrogates, round one"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concat_and_cut(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label_quality(_table(spark, sf_dir, "documents"))


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(_table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op5_unigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_held_out(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule failed first depends on the measured order
    return quality_cascade(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op9_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_surrogates": op1_surrogates,
    "op2_concat_and_cut": op2_concat_and_cut,
    "op3_weak_labels": op3_weak_labels,
    "op4_block_anchors": op4_block_anchors,
    "op5_unigram_count": op5_unigram_count,
    "op6_language_profiles": op6_language_profiles,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_latent_retrieval": op9_latent_retrieval,
    "op10_containment": op10_containment,
}

ORACLES: dict[str, str] = {
    "op4_block_anchors": oracles.BLOCK_ANCHORS,
    "op8_quality_cascade": oracles.QUALITY_CASCADE,
}
