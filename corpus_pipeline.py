"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it
kept.  All but the last return the columns of documents.

1. quality_rules       documents that the repetition and length rules reject go
2. line_dedup          boilerplate lines go from the texts; n_chars follows
3. ngram_jaccard_join  of each group of near-duplicates the one with the smallest id stays
4. decontamination     documents that hold a benchmark item go
5. packing             the rest is tokenised and packed; one row per piece
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, line_dedup, ngram_join, packing, quality
from foliant.llm.common import cut, documents
from foliant.llm.tokens import public_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_vocabulary(), end_id=1, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("packing", pack_windows),
]

#: Suffix arrays, near-duplicate components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
