"""Queries over evaluation sets and synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, knowledge, metrics, modes
from .catalogue import query, table
from .retrieval import _CASES, _KNN, _cases, _lists


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, nullif(l_discount, 0) AS d FROM lineitem), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN q + 1 ELSE q END AS q, d FROM g WHERE l_linenumber <> 3),
j AS (SELECT 'q' AS field, g.q AS gold, a.q AS actual FROM g LEFT JOIN a USING (l_orderkey, l_linenumber) UNION ALL SELECT 'd', g.d, a.d FROM g LEFT JOIN a USING (l_orderkey, l_linenumber))
SELECT field, count(*) AS compared, count(*) FILTER (abs(gold - actual) <= 1e-6) AS correct, count(*) FILTER (actual IS NULL) AS missing,
  round(avg(CASE WHEN abs(gold - actual) <= 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j WHERE gold IS NOT NULL GROUP BY field""")
def gold_comparison(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.expr("nullif(l_discount, 0)").alias("d"))
    actual = gold.filter("l_linenumber <> 3").withColumn("q", F.when(F.col("l_linenumber") == 2, F.col("q") + 1).otherwise(F.col("q")))
    return evaluation.against_gold(actual, gold, ["l_orderkey", "l_linenumber"], ["q", "d"])


@query("""SELECT 'structured:' || p_partkey || ':' || field AS query_id, question, answer FROM (SELECT p_partkey, 'p_brand' AS field, 'Brand of ' || p_name || '?' AS question, p_brand AS answer FROM part
UNION ALL SELECT p_partkey, 'p_type', 'Type of ' || p_name || '?', p_type FROM part) WHERE trim(answer) <> ''""")
def structured_cases(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.structured_cases(table(spark, sf, "part"), "p_partkey", "p_name", {"p_brand": "Brand of %s?", "p_type": "Type of %s?"})
    return out.select("query_id", "question", "answer")


@query("""SELECT count(*) FILTER (old IS NULL AND ok) AS inserted, count(*) FILTER (ok AND old IS NOT NULL AND new <> old) AS updated, count(*) FILTER (ok AND new = old) AS unchanged, count(*) FILTER (NOT ok) AS rejected
FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN text END AS old, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS new, n_chars >= 300 AS ok FROM documents)""")
def corpus_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of a synchronisation: half of the documents are known, a third changed, short ones are rejected."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    source = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    _, stats = knowledge.sync(docs.filter("doc_id % 2 = 0"), source, "doc_id", "text", ["n_chars"], F.when(F.col("n_chars") < 300, "short").otherwise("ok"))
    return stats


@query("""SELECT 'intent' AS dimension, role AS value, count(*) AS cases FROM conversations GROUP BY role UNION ALL
SELECT 'agent', value, count(*) FROM (SELECT unnest(CASE WHEN turn % 2 = 0 THEN ['semantic'] ELSE ['semantic', 'structured'] END) AS value FROM conversations) GROUP BY value UNION ALL SELECT 'unique_questions', NULL, count(DISTINCT text) FROM conversations""")
def dataset_statistics(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "conversations").withColumn("agents", F.when(F.col("turn") % 2 == 0, F.array(F.lit("semantic"))).otherwise(F.array(F.lit("semantic"), F.lit("structured"))))
    return evaluation.statistics(held, "role", "agents", "text")


@query(_KNN + """, a AS (SELECT query, document, rank FROM r WHERE rank <= 10),
b AS (SELECT * FROM (SELECT query, document, row_number() OVER (PARTITION BY query ORDER BY document) AS rank FROM r WHERE rank <= 30 AND label = query_label) WHERE rank <= 10),
c AS (SELECT query, list(document) FILTER (label = query_label AND rank <= 25) AS relevant FROM r GROUP BY query),
m AS (SELECT 'LEXICAL_ONLY' AS mode, query, document, rank FROM b WHERE rank <= 5 UNION ALL SELECT 'VECTOR_ONLY', query, document, rank FROM a WHERE rank <= 5),
s AS (SELECT mode, query, coalesce(max(CASE WHEN list_contains(relevant, document) THEN 1.0 / rank END), 0) AS mrr, count(*) FILTER (list_contains(relevant, document)) / max(len(relevant)) AS recall_5 FROM m JOIN c USING (query) GROUP BY mode, query)
SELECT mode, count(*) AS cases, round(avg(recall_5), 5) AS recall_5, round(CAST(avg(mrr) AS DOUBLE), 5) AS mrr FROM s GROUP BY mode""")
def mode_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of two retrieval modes over the same questions."""
    a, b = _lists(spark, sf)
    results = {m: modes.retrieve(m, a, b) for m in ("VECTOR_ONLY", "LEXICAL_ONLY")}
    return modes.compare_modes(results, _cases(spark, sf).select("query", "relevant")).select("mode", "cases", "recall_5", "mrr")


@query(_CASES + "SELECT count(*) AS cases, CAST(round(avg(CASE WHEN recall_5 >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS good FROM x")
def cases_over_target(spark: SparkSession, sf: str) -> DataFrame:
    held = metrics.retrieval_metrics(_cases(spark, sf))
    return held.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("recall_5") >= 0.2).cast("double")), 6).alias("good"))
