"""The queries opN_* over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chunk_dedup import dedup_chunks
from .common import documents
from .decontaminate import leaks
from .license_scan import scan_licenses
from .line_dedup import SQL as LINE_SQL
from .line_dedup import line_report
from .ngram_join import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality import quality_scores
from .suffix_dedup import dedup_substrings
from .token_store import store_round_trip
from .tokens import public_vocabulary


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(documents(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_vocabulary(), end_id=1, capacity=2048)


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(documents(spark, sf_dir), public_vocabulary(), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_chunk_dedup": op3_chunk_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_ngram_join": op6_ngram_join,
        "op7_packing": op7_packing,
        "op8_token_store": op8_token_store,
        "op9_quality_rules": op9_quality_rules,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": LINE_SQL}
