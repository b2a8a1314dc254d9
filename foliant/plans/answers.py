"""A batch of questions from gate to answer, as one plan.

Each question passes the gate, gets slots and an intent, its structured part from the
registry and its evidence from BM25, and the guardrail decides what may be said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import lexical, resolve, routing


def answer_batch(questions: DataFrame, docs: DataFrame, registry: DataFrame, k: int = 3) -> DataFrame:
    """(conv_id, turn, decision, intent, action, answer, sources) for every question."""
    q = questions.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("q"), "text")
    routed = routing.route(q, "text")
    passing = routed.filter("gate.decision = 'PASS'")
    hits = lexical.bm25_topk(docs.select("doc_id", "text"), passing.select("q", "text"), k, query_key="q")
    shown = hits.join(docs.select(F.col("doc_id").alias("document"), snippet("text", 120).alias("snippet")), "document")
    evidence = shown.groupBy(F.col("query").alias("q")).agg(
        F.max("score").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "document", "snippet"))), lambda s: s["document"]).alias("sources"), F.min_by("snippet", "rank").alias("snippet")
    )
    named = passing.filter("slots.name is not null").select("q", F.col("slots.name").alias("name"))
    found = resolve.resolve(named, registry.select("p_partkey", "p_name"), "q", "name", "p_partkey", "p_name")
    found = found.join(registry.select("p_partkey", "p_retailprice"), "p_partkey", "left").select("q", F.col("status").alias("entity"), "p_retailprice")
    held = routed.join(evidence, "q", "left").join(found, "q", "left")
    intent = F.col("route.intent")
    action = routing.guardrail(intent, F.col("entity") == "AMBIGUOUS", F.col("p_retailprice").isNotNull(), F.col("score"), F.when(F.col("entity") == "RESOLVED", "FOUND").otherwise("NOT_IN_CORPUS"))
    action = F.when(F.col("gate.decision") == "PASS", action).when(F.col("gate.decision") == "CLARIFY", "clarify").otherwise("refuse")
    text = F.when(action != "pass", F.lit(None)).when(F.startswith(intent, F.lit("STRUCTURED")), F.format_string("%.2f", F.col("p_retailprice"))).otherwise(F.col("snippet"))
    return held.select("conv_id", "turn", F.col("gate.decision").alias("decision"), intent.alias("intent"), action.alias("action"), text.alias("answer"), F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<bigint>")), lambda x: x.cast("string")), ",").alias("sources"))
