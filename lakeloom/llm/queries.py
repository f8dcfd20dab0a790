"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_dedup, chat, conversation_repair, licenses, line_dedup, quality, suffix_dedup, token_files, warc, whitening
from .decontaminate import contaminations
from .licenses import license_scan
from .near_dedup import near_duplicate_classes
from .packing import pack_documents
from .quality import quality_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_digests(_table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(_table(spark, sf_dir, "conversations"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.block_dedup(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(_table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(_table(spark, sf_dir, "documents"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: its base columns."""
    return op1_license_scan(spark, sf_dir).drop("labels", "score")


def quality_base_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: its base columns."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


def whitening_base_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op12: the rows that remain and their exact deviations."""
    return op12_embedding_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_warc_revisits": op5_warc_revisits,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_chat_format": op8_chat_format,
        "op9_decontamination": op9_decontamination,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_token_files": op13_token_files,
        "license_base_places": license_base_places,
        "quality_base_measures": quality_base_measures,
        "whitening_base_deviations": whitening_base_deviations,
    }


def oracle_sql() -> dict[str, str]:
    """The others' methods (sketches, darts, tilings, tokenizers, Viterbi paths) have no SQL form; tests compare them with brute force."""
    return {
        "op4_line_dedup": line_dedup.ORACLE,
        "op5_warc_revisits": warc.ORACLE,
        "op6_suffix_dedup": suffix_dedup.ORACLE,
        "op10_substring_dedup": block_dedup.ORACLE,
        "op11_conversation_repair": conversation_repair.ORACLE,
        "license_base_places": licenses.BASE_ORACLE,
        "quality_base_measures": quality.BASE_ORACLE,
        "whitening_base_deviations": whitening.BASE_ORACLE,
    }
