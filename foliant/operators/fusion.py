"""Joining and reranking of ranked candidate lists.

A list has the columns query, document, score and rank.  Every result has a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, token_set
from .lexical import top_k


def rrf(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    each = [x.select("query", "document", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for x, w in zip(lists, weights)]
    fused = reduce(DataFrame.unionByName, each).groupBy("query", "document").agg(F.round(F.sum("part"), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("document"))))


def merge_vector_lexical(vector: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Vector hits in their order with their lexical score, then lexical hits that the vectors lack."""
    v = vector.select("query", "document", F.col("score").alias("vector_score"), F.col("rank").alias("v"))
    x = lexical.select("query", "document", F.col("score").alias("lexical_score"), F.col("rank").alias("x"))
    both = v.join(x, ["query", "document"], "full_outer")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("v").asc_nulls_last(), F.col("x").asc_nulls_last(), "document"))
    return both.withColumn("rank", place).filter(F.col("rank") <= limit).select("query", "document", "vector_score", "lexical_score", "rank")


def filter_or_all(candidates: DataFrame, match: Column, by: str = "query") -> DataFrame:
    """The candidates that match, or all of a query's where none does."""
    held = candidates.withColumn("_match", F.coalesce(match, F.lit(False)))
    held = held.withColumn("_any", F.max("_match").over(Window.partitionBy(by)))
    return held.filter("_match or not _any").drop("_match", "_any")


def boost(candidates: DataFrame, match: Column, by_score: float = 0.08) -> DataFrame:
    """Matching candidates score more, at most 1; ranked anew."""
    score = F.when(F.coalesce(match, F.lit(False)), F.least(F.col("score") + by_score, F.lit(1.0))).otherwise(F.col("score"))
    held = candidates.withColumn("score", score)
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("document"))))


def additive_union(backbone: DataFrame, pools: list[tuple[str, DataFrame]], extra_limit: int | None = None, name: str = "vector") -> DataFrame:
    """The backbone in its order, then what the pools add, in their order; nothing is replaced.

    Other pools that hold a candidate are listed in alt_sources.
    """
    each = [x.select("query", "document", "score", "rank", F.lit(i).alias("pool"), F.lit(n).alias("source")) for i, (n, x) in enumerate([(name, backbone), *pools])]
    held = reduce(DataFrame.unionByName, each)
    first = Window.partitionBy("query", "document").orderBy("pool", "rank")
    held = held.withColumn("_n", F.row_number().over(first)).withColumn("_all", F.collect_list("source").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    held = held.filter("_n = 1").withColumn("alt_sources", F.array_join(F.array_except(F.array_distinct("_all"), F.array("source")), ","))
    place = Window.partitionBy("query").orderBy("pool", "rank", "document")
    out = held.withColumn("_extra", F.sum(F.when(F.col("pool") > 0, 1).otherwise(0)).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    if extra_limit is not None:
        out = out.filter((F.col("pool") == 0) | (F.col("_extra") <= extra_limit))
    return out.withColumn("rank", F.row_number().over(place)).select("query", "document", "score", "rank", "source", "alt_sources")


def head(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.filter(F.col("rank") <= k)


def lexical_rerank(candidates: DataFrame, query_text: str, text: str, k: int, share: float = 0.6) -> DataFrame:
    """share * score + (1 - share) * Jaccard of the token sets."""
    score = F.round(share * F.col("score") + (1 - share) * jaccard(token_set(F.col(query_text)), token_set(F.col(text))), 9)
    return top_k(candidates.withColumn("score", score).drop("rank"), k, ["query"], [F.desc("score"), F.asc("document")])


def tiered_rerank(candidates: DataFrame, tiers: list[Column], k: int) -> DataFrame:
    """Candidates of the first tier that applies come first; within a tier the order stays."""
    tier = reduce(lambda acc, t: F.when(t[1], t[0]) if acc is None else acc.when(t[1], t[0]), enumerate(tiers), None).otherwise(len(tiers))
    held = candidates.withColumn("tier", tier)
    w = Window.partitionBy("query").orderBy("tier", "rank", "document")
    return held.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def candidate_log(candidates: DataFrame, page: str, printed: str) -> DataFrame:
    return candidates.select("query", "rank", "document", F.round("score", 6).alias("score"), F.coalesce(printed, page).alias("page"))
