"""Retrieval queries: BM25, nearest neighbours, fusion, reranking, quality of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..operators import fusion, lexical, metrics, vector
from .catalogue import query, table

_TOKENS = "list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[^a-zà-öø-ÿœßñ0-9_ ]', ' ', 'g')), ' +'), lambda x: length(x) > 1)"

#: Tokens are ASCII and Latin-1 letters here, so that both engines cut alike.
_WORDS = "[^a-zà-öø-ÿœßñ0-9_ ]"


def _plain_tokens(c):
    low = F.regexp_replace(F.lower(c), _WORDS, " ")
    return F.filter(F.split(F.trim(low), " +"), lambda x: F.length(x) > 1)


_BM25 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents),
s AS (SELECT count(*) AS n, greatest(coalesce(avg(len(t)), 0), 1) AS mean FROM d),
p AS (SELECT doc_id, len AS length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT q.query, p.doc_id AS document,
  round(sum(q.times * ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.length / s.mean))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
"""


@query(_BM25 + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM r WHERE score > 0) WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five documents that answer each benchmark item best."""
    return lexical.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 5, tokens=_plain_tokens)


@query(f"""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM p GROUP BY term
""")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    held = lexical.postings(table(spark, sf, "documents"), "doc_id", "text", _plain_tokens)
    return held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0")


_KNN = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
k AS (SELECT a.vec_id AS query, b.vec_id AS document, a.label AS query_label, b.label AS label,
  round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS score
  FROM e a, e b WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM k)
"""


def _hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    found = vector.knn(table(spark, sf, "embeddings"), _queries(spark, sf), k + 20).withColumn("score", F.round("score", 9)).drop("rank")
    return lexical.top_k(found, k, ["query"], [F.desc("score"), F.asc("document")])


@query(_KNN + "SELECT query, document, score, rank FROM r WHERE rank <= 10")
def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, 10)


def _with_labels(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return hits.join(e.select(F.col("vec_id").alias("document"), "label"), "document").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")), "query")


@query(_KNN + """, t AS (SELECT *, max(label = query_label) OVER (PARTITION BY query) AS anyc FROM r WHERE rank <= 10)
SELECT query, document, rank FROM t WHERE label = query_label OR NOT anyc""")
def metadata_filter_fallback(spark: SparkSession, sf: str) -> DataFrame:
    held = _with_labels(spark, sf, _hits(spark, sf, 10))
    return fusion.filter_or_all(held, F.col("label") == F.col("query_label")).select("query", "document", "rank")


@query(_KNN + """, t AS (SELECT query, document, CASE WHEN label = query_label THEN least(score + 0.08, 1.0) ELSE score END AS s FROM r WHERE rank <= 10)
SELECT query, document, round(s, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, document) AS rank FROM t""")
def metadata_boost_topk(spark: SparkSession, sf: str) -> DataFrame:
    held = _with_labels(spark, sf, _hits(spark, sf, 10))
    return fusion.boost(held, F.col("label") == F.col("query_label")).select("query", "document", F.round("score", 6).alias("score"), "rank")


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists for the same queries: neighbours, and the same neighbours by id among those with their label."""
    hits = _hits(spark, sf, 10)
    other = _with_labels(spark, sf, _hits(spark, sf, 30)).filter("label = query_label")
    return hits, lexical.top_k(other.drop("rank"), 10, ["query"], [F.asc("document")]).select("query", "document", "score", "rank")


_TWO = _KNN + """, a AS (SELECT query, document, score, rank FROM r WHERE rank <= 10),
b AS (SELECT * FROM (SELECT query, document, score, row_number() OVER (PARTITION BY query ORDER BY document) AS rank FROM r WHERE rank <= 30 AND label = query_label) WHERE rank <= 10)
"""


@query(_TWO + """, u AS (SELECT query, document, 1.0 / (60 + rank) AS p FROM a UNION ALL SELECT query, document, 0.5 / (60 + rank) FROM b),
g AS (SELECT query, document, round(CAST(sum(p) AS DOUBLE), 9) AS score FROM u GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM g""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lists(spark, sf)
    return fusion.rrf([a, b], weights=[1.0, 0.5])


@query(_TWO + """, m AS (SELECT query, document, a.score AS vector_score, b.score AS lexical_score,
  row_number() OVER (PARTITION BY query ORDER BY a.rank NULLS LAST, b.rank NULLS LAST, document) AS rank FROM a FULL JOIN b USING (query, document))
SELECT * FROM m WHERE rank <= 15""")
def vector_lexical_merge(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lists(spark, sf)
    return fusion.merge_vector_lexical(a, b, 15)


@query(_TWO + """, u AS (SELECT *, 0 AS pool, 'vector' AS source FROM a UNION ALL SELECT *, 1, 'label' FROM b),
f AS (SELECT *, row_number() OVER (PARTITION BY query, document ORDER BY pool, rank) AS n, count(*) OVER (PARTITION BY query, document) AS c FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pool, rank, document) AS place FROM f WHERE n = 1),
x AS (SELECT *, sum(pool) OVER (PARTITION BY query ORDER BY place) AS extra FROM o)
SELECT query, document, score, row_number() OVER (PARTITION BY query ORDER BY place) AS rank, source,
  CASE WHEN c > 1 THEN 'label' ELSE '' END AS alt_sources FROM x WHERE pool = 0 OR extra <= 5""")
def additive_union_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lists(spark, sf)
    return fusion.additive_union(a, [("label", b)], extra_limit=5)


@query(_TWO + """, j AS (SELECT a.query, a.document, a.rank, CASE WHEN e.label = q.label THEN 0 WHEN a.document % 2 = 0 THEN 1 ELSE 2 END AS tier
  FROM a JOIN embeddings e ON e.vec_id = a.document JOIN embeddings q ON q.vec_id = a.query),
t AS (SELECT query, document, CAST(tier AS INTEGER) AS tier, row_number() OVER (PARTITION BY query ORDER BY tier, rank, document) AS rank FROM j)
SELECT * FROM t WHERE rank <= 5""")
def tiered_rerank(spark: SparkSession, sf: str) -> DataFrame:
    held = _with_labels(spark, sf, _hits(spark, sf, 10))
    out = fusion.tiered_rerank(held, [F.col("label") == F.col("query_label"), F.col("document") % 2 == 0], 5)
    return out.select("query", "document", "tier", "rank")


@query(_BM25 + f""", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM r WHERE score > 0) WHERE rank <= 20),
w AS (SELECT t.query, t.document, t.score, list_distinct({_TOKENS.format('b.text')}) AS a, list_distinct({_TOKENS.format('d.text')}) AS c
  FROM t JOIN benchmark b ON b.item_id = t.query JOIN documents d ON d.doc_id = t.document),
z AS (SELECT query, document, round(0.6 * score + 0.4 * len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))), 5) AS score FROM w)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS rank FROM z) WHERE rank <= 5""")
def lexical_rerank_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    hits = lexical.bm25_topk(docs, items, 20, tokens=_plain_tokens)
    held = hits.join(docs.select(F.col("doc_id").alias("document"), _plain_tokens(F.col("text")).alias("d")), "document").join(items.select(F.col("item_id").alias("query"), _plain_tokens(F.col("text")).alias("q")), "query")
    share = F.size(F.array_intersect("q", "d")) / F.size(F.array_union("q", "d"))
    scored = held.select("query", "document", F.round(0.6 * F.col("score") + 0.4 * share, 5).alias("score"))
    return lexical.top_k(scored, 5, ["query"], [F.desc("score"), F.asc("document")])


_CASES = _KNN + """, c AS (SELECT query, list(document ORDER BY rank) FILTER (rank <= 10) AS retrieved, list(document ORDER BY document) FILTER (label = query_label AND rank <= 25) AS relevant FROM r GROUP BY query),
m AS (SELECT query, retrieved, relevant,
  list_filter(list_transform(generate_series(1, len(retrieved)), lambda i: CASE WHEN list_contains(relevant, retrieved[i]) THEN i END), lambda i: i IS NOT NULL) AS hits FROM c),
x AS (SELECT query,
  round(len(list_filter(hits, lambda i: i <= 1)) / len(relevant), 6) AS recall_1, round(len(list_filter(hits, lambda i: i <= 3)) / len(relevant), 6) AS recall_3,
  round(len(list_filter(hits, lambda i: i <= 5)) / len(relevant), 6) AS recall_5, round(len(hits) / len(relevant), 6) AS recall_10,
  round(len(list_filter(hits, lambda i: i <= 5)) / 5, 6) AS precision_5, CASE WHEN len(list_filter(hits, lambda i: i <= 5)) > 0 THEN 1.0 ELSE 0.0 END AS hit_5,
  round(coalesce(1.0 / list_min(hits), 0.0), 6) AS mrr,
  round(coalesce(list_sum(list_transform(hits, lambda i: 3 / log2(i + 1))), 0) / list_sum(list_transform(generate_series(1, least(10, len(relevant))), lambda i: 3 / log2(i + 1))), 6) AS ndcg_10
  FROM m)
"""
_METRICS = ["recall_1", "recall_3", "recall_5", "recall_10", "precision_5", "hit_5", "mrr", "ndcg_10"]


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    held = _with_labels(spark, sf, _hits(spark, sf, 25))
    ordered = lambda c, keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct(*c)))), lambda s: s["document"])
    return held.groupBy("query").agg(ordered(["rank", "document"], F.col("rank") <= 10).alias("retrieved"), ordered(["document"], F.col("label") == F.col("query_label")).alias("relevant"))


@query(_CASES + f"SELECT query, {', '.join(f'CAST({m} AS DOUBLE) AS {m}' for m in _METRICS)} FROM x")
def ir_metrics_per_case(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.retrieval_metrics(_cases(spark, sf)).select("query", *_METRICS)


@query(_CASES + f"SELECT count(*) AS cases, {', '.join(f'CAST(round(avg({m}), 5) AS DOUBLE) AS {m}' for m in _METRICS)} FROM x")
def ir_metrics_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_metrics(metrics.retrieval_metrics(_cases(spark, sf)), _METRICS, places=5)


_SPOILT = "CASE vec_id % 50 WHEN 7 THEN NULL WHEN 8 THEN {cut} WHEN 9 THEN {one} ELSE embedding END"


@query(f"""WITH e AS (SELECT vec_id, {_SPOILT.format(cut='embedding[1:0]', one='embedding[1:5]')} AS v FROM embeddings)
SELECT vec_id, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) = 0 THEN 'empty' ELSE 'dimension' END AS reason FROM e WHERE v IS NULL OR len(v) <> 64""")
def embedding_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, some of them taken away, emptied or cut short."""
    held = table(spark, sf, "embeddings").select("vec_id", F.expr(_SPOILT.format(cut="slice(embedding, 1, 0)", one="slice(embedding, 1, 5)")).alias("v"))
    return vector.embedding_failures(held, "vec_id", "v", 64)


@query(f"""
WITH a AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM documents),
q AS (SELECT item_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
o AS (SELECT item_id AS query, doc_id AS document, count(*) AS overlap FROM a JOIN q USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, document) AS rank FROM o) WHERE rank <= 3""")
def token_overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.overlap_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 3, "doc_id", "text", "item_id", "text", _plain_tokens)


@query()
def lexical_token_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The production tokeniser over all benchmark items."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(lexical_tokens("text"), " ").alias("tokens"))


@query("""SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings QUALIFY rank <= 3""")
def latest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc("vec_id"))
    return table(spark, sf, "embeddings").select("label", "vec_id", F.row_number().over(w).alias("rank")).filter("rank <= 3")
