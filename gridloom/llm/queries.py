"""The corpus operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, langid, license, lm, media, oracles, packing, secrets, simhash, substring, suffix
from gridloom.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.audio_columns(table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(substring.dedup_words(table(spark, sf_dir, "documents")), "words", "n_words")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.dedup_bytes(table(spark, sf_dir, "documents")), "bytes", "n_bytes")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_groups(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(license.scan_licenses(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_lm_scoring, op3_media_columns, op4_decontamination, op5_packing, op6_language_id, op7_substring_dedup, op8_suffix_dedup, op9_simhash_dedup, op10_license_scan)
}

#: The others rest on trained models, XXH64 or a tokenizer, which SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": oracles.DECONTAMINATION,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_suffix_dedup": oracles.SUFFIX_DEDUP,
}
