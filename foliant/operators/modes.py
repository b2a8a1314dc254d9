"""Retrieval modes: which pools are asked and how they are joined.

Pools are ranked lists (query, document, score, rank).  A mode takes candidate_k from each
pool and gives final_k; where the page of a question is known, `page_match` marks its
candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fusion

#: The modes, and how many candidates each pool gives and a question gets.
MODES = ["VECTOR_ONLY", "LEXICAL_ONLY", "VECTOR_LEXICAL", "VECTOR_METADATA", "RRF", "HYBRID_RERANK", "EVIDENCE_CANDIDATES"]
CANDIDATES, FINAL = 30, 5


def retrieve(mode: str, vector: DataFrame, lexical: DataFrame, page_match: Column | None = None, texts: tuple[DataFrame, DataFrame] | None = None, pools: list[tuple[str, DataFrame]] | None = None, tiers: list[Column] | None = None, candidate_k: int = CANDIDATES, final_k: int = FINAL) -> DataFrame:
    """(query, document, score, rank) of one mode; texts are (documents (document, text), queries (query, question))."""
    vector, lexical = fusion.head(vector, candidate_k), fusion.head(lexical, candidate_k)
    if mode == "VECTOR_ONLY":
        out = vector
    elif mode == "LEXICAL_ONLY":
        out = lexical
    elif mode == "VECTOR_LEXICAL":
        out = fusion.merge_vector_lexical(vector, lexical, candidate_k).withColumn("score", F.coalesce("vector_score", "lexical_score"))
    elif mode == "VECTOR_METADATA":
        out = vector if page_match is None else _ranked(fusion.filter_or_all(vector, page_match))
    elif mode == "RRF":
        out = fusion.rrf([vector, lexical])
    elif mode == "HYBRID_RERANK":
        documents, questions = texts
        held = fusion.merge_vector_lexical(vector, lexical, candidate_k).withColumn("score", F.coalesce("vector_score", "lexical_score"))
        out = fusion.lexical_rerank(held.join(documents, "document").join(questions, "query"), "question", "text", final_k)
    elif mode == "EVIDENCE_CANDIDATES":
        held = fusion.additive_union(vector, [*(pools or []), ("lexical", lexical)])
        out = fusion.tiered_rerank(held, tiers, final_k) if tiers else held
    else:
        raise ValueError(mode)
    return fusion.head(out, final_k).select("query", "document", "score", "rank")


def _ranked(candidates: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "document")))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """First results; those of the second mode for questions that got none."""
    return first.unionByName(second.join(first.select("query").distinct(), "query", "left_anti"))


def limited_pool(rows: DataFrame, usable: Column, limit: int, order: list) -> DataFrame:
    """At most `limit` usable rows for each question, in order, as a pool."""
    from .lexical import top_k

    return top_k(rows.filter(F.coalesce(usable, F.lit(False))), limit, ["query"], order)


def compare_modes(results: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """Quality of each mode over questions with relevant ids (query, relevant)."""
    from functools import reduce

    from . import metrics

    each = [r.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document"))), lambda s: s["document"]).alias("retrieved")).withColumn("mode", F.lit(m)) for m, r in results.items()]
    held = reduce(DataFrame.unionByName, each).join(relevant, "query")
    scored = metrics.retrieval_metrics(held)
    return scored.groupBy("mode").agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 5).alias(m) for m in ("recall_1", "recall_3", "recall_5", "mrr")])
