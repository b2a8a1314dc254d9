"""Queries over whole tables of cells, candidates, facts, cases and chunks, worded from lineitem and the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, fusion, gold, knowledge, layout, metrics, quality, resolve, review, structured
from ..sources import records
from .catalogue import query, table

_IDS = ["l_orderkey", "l_linenumber"]


#: Line numbers made unique within an order, so that a row has a place.
_NUMBER = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT)"
_LINES = f"(SELECT * REPLACE ({_NUMBER} AS l_linenumber) FROM lineitem)"


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("l_linenumber", F.expr(_NUMBER))


def _lines(spark: SparkSession, sf: str, **words: str) -> DataFrame:
    return _numbered(spark, sf).select(*_IDS, *[F.expr(w).alias(n) for n, w in words.items()])


def _worded(**words: str) -> str:
    return "WITH c AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{w} AS {n}" for n, w in words.items()) + f" FROM {_LINES})"


@query("""WITH b AS (SELECT l_orderkey, row_number() OVER w AS r, coalesce((lag(20.0 * l_linenumber) OVER w + 20.0 * l_linenumber) / 2, 0) AS y0, coalesce((lead(20.0 * l_linenumber) OVER w + 20.0 * l_linenumber) / 2, 150) AS y1 FROM {lines} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
w AS (SELECT l_orderkey, l_linenumber, 3.5 * l_quantity AS y FROM {lines}),
j AS (SELECT w.l_orderkey, w.l_linenumber, min(CASE WHEN y >= y0 AND y < y1 THEN r END) AS inside, min(least(abs(y0 - y), abs(y1 - y))) AS d, arg_min(r, [least(abs(y0 - y), abs(y1 - y)), r]) AS near FROM w JOIN b USING (l_orderkey) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(coalesce(inside, CASE WHEN d <= 18 THEN near END) AS INT) AS row_index FROM j""".replace("{lines}", _LINES))
def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Words put into the bands of their page's anchors."""
    anchors = _lines(spark, sf, y="CAST(20 * l_linenumber AS DOUBLE)")
    words = _lines(spark, sf, y="3.5 * l_quantity")
    return layout.rows_of_words(words, layout.bands(anchors, "l_orderkey", "y", 0.0, 150.0), "l_orderkey", "y").select(*_IDS, "row_index")


_Y = "CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN l_quantity END"


@query(
    _worded(y=_Y)
    + """, k AS (SELECT l_orderkey, list(struct_pack(i := l_linenumber, y := y) ORDER BY l_linenumber) AS ks FROM c WHERE y IS NOT NULL GROUP BY 1),
p AS (SELECT c.*, last_value(CASE WHEN y IS NOT NULL THEN l_linenumber END IGNORE NULLS) OVER a AS ai, last_value(y IGNORE NULLS) OVER a AS ay, first_value(CASE WHEN y IS NOT NULL THEN l_linenumber END IGNORE NULLS) OVER b AS bi, first_value(y IGNORE NULLS) OVER b AS by_,
  CASE WHEN len(ks) > 1 THEN (ks[2].y - ks[1].y) / (ks[2].i - ks[1].i) ELSE 30.0 END AS s FROM c LEFT JOIN k USING (l_orderkey)
  WINDOW a AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT l_orderkey, l_linenumber, round(CASE WHEN y IS NOT NULL THEN y WHEN ai IS NOT NULL AND bi IS NOT NULL THEN ay + (by_ - ay) * (l_linenumber - ai) / (bi - ai) WHEN ai IS NOT NULL THEN ay + (l_linenumber - ai) * s WHEN bi IS NOT NULL THEN by_ - (bi - l_linenumber) * s END, 6) AS y FROM p"""
)
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a position, between known ones or beyond them."""
    return layout.extrapolate(_lines(spark, sf, y=_Y), "l_orderkey", "l_linenumber", "y").select(*_IDS, F.round("y_resolved", 6).alias("y"))


_ROW = {"n": "CASE WHEN l_linenumber % 3 = 0 THEN concat('n', l_linenumber) END", "a": "concat('a', l_linenumber)", "b": "CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END", "d": "CASE WHEN l_linestatus = 'F' THEN 'f' END"}


@query(
    _worded(**_ROW)
    + """, f AS (SELECT *, n IS NULL AND 1 + CAST(b <> '' AS INT) + CAST(d IS NOT NULL AS INT) <= 2 AS waits FROM c),
t AS (SELECT *, first_value(CASE WHEN NOT waits THEN l_linenumber END IGNORE NULLS) OVER w AS target, first_value(CASE WHEN NOT waits THEN n IS NOT NULL END IGNORE NULLS) OVER w AS numbered FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, CASE WHEN waits AND coalesce(numbered, false) THEN target ELSE l_linenumber END AS too FROM t)
SELECT l_orderkey, too AS l_linenumber, max(n) AS n, string_agg(a, ' ' ORDER BY l_linenumber) AS a, coalesce(string_agg(b, ' ' ORDER BY l_linenumber) FILTER (b <> ''), '') AS b, coalesce(string_agg(d, ' ' ORDER BY l_linenumber) FILTER (d IS NOT NULL), '') AS d, count(*) AS merged FROM g GROUP BY l_orderkey, too"""
)
def continued_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Continuation rows joined to the numbered row that follows."""
    return layout.logical_rows(_lines(spark, sf, **_ROW), "l_orderkey", "l_linenumber", "n", ["a", "b", "d"])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount < 0.95 THEN 'low_score' WHEN l_quantity > 25 THEN 'too_tall' END AS reject FROM {lines} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY 1 - l_discount DESC, l_extendedprice DESC) = 1""".replace("{lines}", _LINES))
def chosen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of each cell, or why it is refused."""
    held = _numbered(spark, sf).withColumn("score", 1 - F.col("l_discount"))
    return layout.choose_candidate(held, ["l_orderkey"], "score", "l_extendedprice", "l_quantity", 0.95).select(*_IDS, "reject")


@query("""WITH k AS (SELECT s_suppkey AS id, s_suppkey * 3 % 40 + 1 AS f, s_suppkey * 3 % 40 + 1 + s_suppkey % 7 AS l FROM supplier), p AS (SELECT DISTINCT page_id % 60 AS page FROM pages)
SELECT page, f AS first_page, l AS last_page FROM p LEFT JOIN k ON page BETWEEN f AND l QUALIFY row_number() OVER (PARTITION BY page ORDER BY l - f, f DESC) = 1""")
def cached_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The narrowest cached range that covers each page."""
    pages = table(spark, sf, "pages").select((F.col("page_id") % 60).alias("page"))
    first = F.col("s_suppkey") * 3 % 40 + 1
    caches = table(spark, sf, "supplier").select(first.alias("first_page"), (first + F.col("s_suppkey") % 7).alias("last_page")).distinct()
    return layout.best_cache(pages, caches, "page", "first_page", "last_page")


_CELL = {"row_index": "CAST(l_orderkey % 5 AS INT)", "column_index": "l_linenumber", "text": "CASE WHEN l_linenumber = 2 THEN CASE WHEN l_orderkey % 3 = 0 THEN ' 71-43-2 ' ELSE 'none' END ELSE concat(' ', l_returnflag, ' ') END"}
_PICK = ", ".join(f"max(CASE WHEN column_index = {i} THEN trim(text) END) AS {n}" for i, n in {1: "name", 2: "cas", 3: "twa"}.items())


@query(
    _worded(**_CELL)
    + f""", t AS (SELECT l_orderkey, row_index, {_PICK} FROM c WHERE row_index >= 2 GROUP BY 1, 2), z AS (SELECT *, nullif(regexp_extract(cas, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]'), '') AS number FROM t)
SELECT l_orderkey, row_index, name, number, twa, number IS NOT NULL AND coalesce(name, '') <> '' AS accepted FROM z"""
)
def assembled_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to typed rows, and those to limits that are accepted or go to review."""
    good, rest = gold.assemble_limits(_lines(spark, sf, **_CELL), ["l_orderkey"], {1: "name", 2: "cas", 3: "twa"})
    both = good.withColumn("accepted", F.lit(True)).unionByName(rest.withColumn("accepted", F.lit(False)))
    return both.select("l_orderkey", "row_index", "name", "number", "twa", "accepted")


@query(
    _worded(**_CELL)
    + """, s AS (SELECT l_orderkey, CASE WHEN column_index > 2 THEN column_index + 1 ELSE column_index END AS col, row_index, l_linenumber FROM c)
SELECT l_orderkey, col AS column_index, count(*) AS cells, avg(CASE WHEN col <> 1 THEN CAST(l_linenumber AS DOUBLE) END) AS y FROM s GROUP BY 1, 2"""
)
def shifted_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Room made for a column that the scan joined, and the mean positions of the rest."""
    cells = gold.shift_columns(_lines(spark, sf, **_CELL), 2).withColumn("y", F.col("l_linenumber").cast("double"))
    count = cells.groupBy("l_orderkey", "column_index").agg(F.count("*").alias("cells"))
    return count.join(layout.mean_positions(cells, ["l_orderkey", "column_index"], "y", 1), ["l_orderkey", "column_index"], "left")


@query("""WITH RECURSIVE v AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
g AS (SELECT conv_id, i, 0 AS chunk, text FROM v WHERE i = 1 UNION ALL SELECT v.conv_id, v.i, CASE WHEN length(g.text) + 1 + length(v.text) <= 300 THEN g.chunk ELSE g.chunk + 1 END, CASE WHEN length(g.text) + 1 + length(v.text) <= 300 THEN g.text || chr(10) || v.text ELSE v.text END FROM g JOIN v ON v.conv_id = g.conv_id AND v.i = g.i + 1)
SELECT conv_id, chunk, arg_max(text, i) AS text FROM g GROUP BY 1, 2""")
def packed_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns packed into chunks of at most 300 characters."""
    return layout.pack_paragraphs(table(spark, sf, "conversations"), "conv_id", "turn", "text", 300)


_PAGE = "concat('ahv = sqrt a ', l_linenumber, '\n', 'text T1=', l_returnflag, ' / 8', '\n', 'no formula')"


@query(
    _worded(body=_PAGE.replace("'\n'", "chr(10)"))
    + r""", f AS (SELECT *, regexp_extract_all(body, '([A-Za-z][A-Za-z0-9_]{0,8}\s*=\s*[^\n=]{1,120})', 1) AS e FROM c), u AS (SELECT l_orderkey, l_linenumber, e, unnest(generate_series(1, len(e))) AS i FROM f)
SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INT) AS position, trim(e[i]) AS expression, CASE WHEN regexp_matches(trim(e[i]), '^ahv') THEN 'executable' ELSE 'registry_only' END AS support FROM u"""
)
def page_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas on pages and whether they can be computed."""
    pages = _lines(spark, sf, body=_PAGE.replace("\n", "\\n")).withColumn("page", F.struct(*_IDS))
    found = evaluation.formula_inventory(gold.formula_candidates(pages, "page", "body"), "expression", ["^ahv"])
    return found.select("page.*", "position", "expression", "support")


@query("""WITH t AS (SELECT p_partkey, p_name AS subject, 'brand' AS predicate, p_brand AS object, 'cell' || (p_partkey % 50) AS cell FROM part), k AS (SELECT 'cell' || s_suppkey AS cell_id, s_name AS text FROM supplier)
SELECT p_partkey, subject, predicate, object, text AS object_text FROM t LEFT JOIN k ON cell = cell_id""")
def resolved_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Triples with the text of the cell that they come from."""
    part = table(spark, sf, "part").withColumn("cell", F.concat(F.lit("cell"), (F.col("p_partkey") % 50).cast("string")))
    triples = gold.triples(part, ["p_partkey", "cell"], "p_name", {"p_brand": "brand"})
    cells = table(spark, sf, "supplier").select(F.concat(F.lit("cell"), F.col("s_suppkey").cast("string")).alias("cell_id"), F.col("s_name").alias("text"))
    return gold.resolve_triples(triples, cells, "cell").select("p_partkey", "subject", "predicate", "object", "object_text")


_SUBJECT = {"name_a": "CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE l_returnflag END", "name_b": "CASE WHEN l_linenumber = 6 THEN 'b' END", "raw": "CASE WHEN l_linenumber = 3 THEN '  the  original ' END"}


@query(_worded(**_SUBJECT) + r" SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(name_a), ''), nullif(trim(name_b), ''), nullif(trim(regexp_replace(raw, '\s+', ' ', 'g')), '')) AS subject FROM c WHERE coalesce(nullif(trim(name_a), ''), nullif(trim(name_b), ''), nullif(trim(raw), '')) IS NOT NULL")
def subject_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with the first name they have; those without any are dropped."""
    return gold.schema_rows(_lines(spark, sf, **_SUBJECT), ["name_a", "name_b"], "raw").select(*_IDS, "subject")


@query("""WITH l AS (SELECT 't' || (l_orderkey % 7) || ':row_' || (l_linenumber + l_orderkey % 3) || ':x' AS key FROM lineitem), d AS (SELECT DISTINCT key, split_part(key, ':', 1) AS t, CAST(regexp_extract(key, 'row_([0-9]+)', 1) AS INT) AS r FROM l),
c AS (SELECT 't' || (s_suppkey % 7) AS t, s_suppkey % 10 AS r, s_suppkey % 4 AS col, 'c' || s_suppkey AS cell FROM supplier) SELECT key, count(DISTINCT cell) AS cells FROM d LEFT JOIN (SELECT * FROM c WHERE col IN (1, 2)) USING (t, r) GROUP BY key""")
def audited_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Limits with the cells that their keys point at."""
    limits = table(spark, sf, "lineitem").select(F.expr("concat('t', l_orderkey % 7, ':row_', l_linenumber + l_orderkey % 3, ':x')").alias("key")).distinct()
    cells = table(spark, sf, "supplier").select(F.expr("concat('t', s_suppkey % 7)").alias("table_id"), F.expr("CAST(s_suppkey % 10 AS INT)").alias("row_index"), (F.col("s_suppkey") % 4).alias("column_index"), F.expr("concat('c', s_suppkey)").alias("cell_id"))
    return structured.evidence_audit(limits, cells, "key", [1, 2])


@query(r"""WITH o AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '78.11' WHEN 1 THEN '10/85' WHEN 2 THEN 'unknown' END AS w FROM part), z AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 78.11 WHEN 1 THEN 85.10 END AS v, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS stored FROM part)
SELECT p_partkey, CAST(coalesce(v, stored) AS DOUBLE) AS molecular_weight, CASE WHEN v IS NOT NULL THEN 'original' WHEN stored IS NOT NULL THEN 'registry' END AS origin, concat_ws(chr(10), 'p_partkey: ' || p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'w: ' || w END) AS body FROM z JOIN o USING (p_partkey)""")
def molecular_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights as the source has them, else the registry's; and the text of a row."""
    part = table(spark, sf, "part").select("p_partkey", F.expr("CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END").alias("stored"))
    originals = table(spark, sf, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN '78.11' WHEN 1 THEN '10/85' WHEN 2 THEN 'unknown' END").alias("w"))
    weights = structured.molecular_weight(part, originals, "p_partkey", "w", "stored")
    return weights.join(originals, "p_partkey").select("p_partkey", "molecular_weight", "origin", structured.row_text(["p_partkey", "w"]).alias("body"))


_CHUNK = {
    "source_type": "CASE WHEN l_returnflag = 'R' THEN 'manual' ELSE 'standard' END",
    "validation_status": "CASE WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'candidate' END",
    "embedding": "CASE WHEN l_linenumber <> 4 THEN l_quantity END",
    "language": "CASE WHEN l_linenumber = 5 THEN 'de' ELSE 'fa' END",
    "chunk_id": "CASE WHEN l_linenumber = 6 THEN concat('test_', l_orderkey) ELSE concat('c', l_orderkey) END",
    "document_id": "CAST(l_orderkey % 3 AS INT)",
}
_SCOPE = "source_type IN ('standard') AND validation_status = 'accepted' AND embedding IS NOT NULL AND language IN ('fa') AND NOT starts_with(chunk_id, 'test_') AND document_id = 1"


@query(_worded(**_CHUNK) + f" SELECT l_orderkey, l_linenumber, CASE WHEN validation_status = 'accepted' THEN embedding IS NOT NULL END AS embedded FROM c WHERE NOT ({_SCOPE})")
def out_of_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that no retrieval path may return."""
    chunks = _lines(spark, sf, **_CHUNK)
    lost = structured.scope_violations(chunks, structured.production_scope(["standard"], ["fa"], 1))
    return lost.select(*_IDS, F.when(F.col("validation_status") == "accepted", F.col("embedding").isNotNull()).alias("embedded"))


@query(_worded(**_CHUNK) + " SELECT count(*) AS accepted, count(embedding) AS embedded FROM c WHERE validation_status = 'accepted'")
def accepted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.corpus_counts(_lines(spark, sf, **_CHUNK))


@query("""WITH a AS (SELECT p_partkey AS k, lower(trim(unnest([p_name, p_type]))) AS a FROM part), s AS (SELECT a, min(k) AS k FROM (SELECT DISTINCT k, a FROM a) GROUP BY a HAVING count(*) = 1) SELECT DISTINCT p_name AS name, k AS p_partkey FROM part JOIN s ON lower(trim(p_name)) = a""")
def alias_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Names that one part only has."""
    part = table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("name")).distinct()
    return resolve.alias_owner(names, part.select("p_partkey", F.array("p_name", "p_type").alias("aliases")), "name", "p_partkey", "aliases")


_CODES = "CASE o_orderpriority WHEN '1-URGENT' THEN {0}('lost', 'odd') WHEN '2-HIGH' THEN {0}('odd') WHEN '3-MEDIUM' THEN {0}('small') ELSE {0}('other') END"
_GRAVE = {"critical": ["lost"], "high": ["odd"], "medium": ["small"]}
_PRIORITY = "CASE WHEN list_contains(codes, 'lost') THEN 'critical' WHEN list_contains(codes, 'odd') THEN 'high' WHEN list_contains(codes, 'small') THEN 'medium' ELSE 'low' END"


@query(f"SELECT o_orderkey, {_PRIORITY} AS priority, '" + '{"a":"1","b":"\' || o_orderstatus || \'"}\'' + f" AS payload, count(*) OVER (PARTITION BY o_orderstatus) AS of_reason FROM (SELECT *, {_CODES.format('list_value')} AS codes FROM orders)")
def graded_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities by the gravest code, corrected payloads, tasks of the same reason."""
    orders = table(spark, sf, "orders").withColumn("codes", F.expr(_CODES.format("array")))
    payload = review.apply_corrections(F.lit('{"a":"1","b":"x","c":"y"}'), {"b": F.col("o_orderstatus"), "c": None})
    held = orders.select("o_orderkey", review.priority_of(F.col("codes"), _GRAVE).alias("priority"), payload.alias("payload"), "o_orderstatus")
    return review.open_by_reason(held, "o_orderstatus").drop("o_orderstatus")


@query(f"""WITH cases AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'APPROVE' WHEN 2 THEN 'REJECT' ELSE 'CLAIMED' END AS status, 'low' AS priority, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0),
found AS (SELECT o_orderkey AS f, list_sort(list_distinct({_CODES.format('list_value')})) AS codes FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(k, f) AS o_orderkey, CASE WHEN k IS NULL OR (f IS NOT NULL AND status IN ('APPROVE', 'REJECT', 'CORRECT')) THEN 'OPEN' ELSE status END AS status, CASE WHEN f IS NOT NULL THEN {_PRIORITY} ELSE priority END AS priority,
  CAST(coalesce(version, 0) + CASE WHEN k IS NULL OR (f IS NOT NULL AND status IN ('APPROVE', 'REJECT', 'CORRECT')) THEN 1 ELSE 0 END AS INT) AS version FROM cases FULL OUTER JOIN found ON k = f""")
def reopened_cases(spark: SparkSession, sf: str) -> DataFrame:
    """New issues against known cases: fresh ones open, decided ones reopen as the next version."""
    orders = table(spark, sf, "orders")
    status = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'APPROVE' WHEN 2 THEN 'REJECT' ELSE 'CLAIMED' END")
    cases = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", status.alias("status"), F.lit("low").alias("priority"), F.lit(1).alias("version"))
    found = orders.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.explode(F.expr(_CODES.format("array"))).alias("code"))
    return review.upsert_cases(cases, found, "o_orderkey", _GRAVE)


@query("""WITH c AS (SELECT l_returnflag AS d, CASE WHEN l_linenumber > 4 THEN 'late' ELSE 'early' END AS r, l_discount * 10 AS q, l_linestatus FROM lineitem),
u AS (SELECT 'disposition' AS dimension, d AS value FROM c UNION ALL SELECT 'reason', r FROM c UNION ALL SELECT 'confidence', CASE WHEN q >= 0.85 THEN 'high' WHEN q >= 0.65 THEN 'medium' ELSE 'low' END FROM c UNION ALL SELECT 'flag', l_linestatus FROM c WHERE r = 'late')
SELECT dimension, value, count(*) AS rows FROM u GROUP BY 1, 2""")
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by disposition, reason, confidence and flag."""
    late = F.col("l_linenumber") > 4
    held = table(spark, sf, "lineitem").select("l_returnflag", F.when(late, "late").otherwise("early").alias("r"), (F.col("l_discount") * 10).alias("q"), F.when(late, F.array("l_linestatus")).alias("flags"))
    return quality.scope_summary(held, "l_returnflag", "r", "q", "flags")


@query("""WITH m AS (SELECT avg(CAST(quality AS DOUBLE)) AS quality, 1 - avg(CAST(toxic AS DOUBLE)) AS clean FROM labels), u AS (SELECT 'quality' AS metric, quality AS actual, CAST(0.5 AS DOUBLE) AS target FROM m UNION ALL SELECT 'clean', clean, 0.99 FROM m)
SELECT metric, round(actual, 6) AS actual, target, coalesce(actual >= target, false) AS met FROM u""")
def accepted_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Measures against their targets."""
    m = table(spark, sf, "labels").agg(F.avg("quality").alias("quality"), (1 - F.avg("toxic")).alias("clean"))
    return quality.acceptance(m, {"quality": 0.5, "clean": 0.99}).withColumn("actual", F.round("actual", 6))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, 'c' || (l_suppkey + CASE WHEN l_linenumber = 1 THEN 1000000 ELSE 0 END) AS cell, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value, l_suppkey % 3 + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS page FROM {lines}), k AS (SELECT 'c' || s_suppkey AS id, s_suppkey || ',5 of 1 0 or 2/5' AS text, s_suppkey % 3 AS page FROM supplier),
j AS (SELECT f.*, id, text, k.page AS there, regexp_replace(text, '\\s', '', 'g') AS t FROM f LEFT JOIN k ON cell = id)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN id IS NULL THEN 'cell_missing' END, CASE WHEN id IS NOT NULL AND there <> page THEN 'page_mismatch' END, CASE WHEN id IS NOT NULL AND NOT (contains(t, value) OR contains(t, replace(value, '.', '/')) OR contains(replace(t, ',', '.'), value)) THEN 'value_not_in_cell' END) AS issues FROM j""".replace("{lines}", _LINES))
def fact_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose cell is missing, on another page, or without the value."""
    facts = _lines(spark, sf, cell="concat('c', l_suppkey + CASE WHEN l_linenumber = 1 THEN 1000000 ELSE 0 END)", value="CAST(CAST(l_quantity AS INT) AS STRING)", page="l_suppkey % 3 + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END")
    cells = table(spark, sf, "supplier").select(F.expr("concat('c', s_suppkey)").alias("cell_id"), F.expr("concat(s_suppkey, ',5 of 1 0 or 2/5')").alias("text"), (F.col("s_suppkey") % 3).alias("page_number"))
    return quality.evidence_issues(facts, cells, "cell", "value", "page").select(*_IDS, "issues")


@query("""WITH r AS (SELECT l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END AS n, 1 + CAST(l_returnflag = 'R' AS INT) + CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linestatus = 'O' AS INT) ELSE 0 END AS ful FROM lineitem),
c AS (SELECT l_suppkey, n, count(*) AS k, sum(ful) AS ful FROM r GROUP BY 1, 2), t AS (SELECT l_suppkey, max(k) AS usual, sum(k) AS k, sum(ful) AS ful, sum(n * k) AS cells FROM c GROUP BY 1)
SELECT l_suppkey, round(least(0.55 * usual / k + 0.45 * ful / cells, 1.0)::DOUBLE, 4) AS confidence FROM t""")
def table_structure(spark: SparkSession, sf: str) -> DataFrame:
    """How regular the rows of each table are."""
    cells = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN array('a', CASE WHEN l_returnflag = 'R' THEN 'r' ELSE ' ' END, CASE WHEN l_linestatus = 'O' THEN 'o' END) ELSE array('a', CASE WHEN l_returnflag = 'R' THEN 'r' END) END")
    held = table(spark, sf, "lineitem").select("l_suppkey", cells.alias("cells"))
    return quality.structural_confidence(held, "l_suppkey", F.col("cells"))


@query("""WITH k AS (SELECT l_orderkey AS t, l_linenumber AS r, l_returnflag || ' base' AS content, l_quantity AS e FROM {lines} WHERE l_linenumber <= 3), v AS (SELECT l_orderkey AS t, (l_linenumber - 1) % 2 + 1 AS r, l_linenumber AS col, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'z' || l_linenumber || 'z' END AS x FROM {lines}),
g AS (SELECT t, r, list(x ORDER BY col) AS xs FROM v GROUP BY 1, 2), j AS (SELECT k.*, coalesce(list_filter(xs, lambda x, i: NOT contains(lower(content), lower(x)) AND list_position(list_transform(xs, lambda y: lower(y)), lower(x)) = i), []) AS more FROM k LEFT JOIN g USING (t, r))
SELECT t, r, array_to_string(list_concat([content], more), chr(10)) AS content, CASE WHEN len(more) = 0 THEN e END AS embedding, 'row_' || t || '_' || lpad(CAST(r AS VARCHAR), 3, '0') AS chunk_id FROM j""".replace("{lines}", _LINES))
def enriched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Row chunks with the cell texts that they lack; a changed text loses its embedding."""
    lines = _numbered(spark, sf)
    chunks = lines.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r"), F.concat("l_returnflag", F.lit(" base")).alias("content"), F.col("l_quantity").alias("embedding"))
    text = F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(F.concat(F.lit("z"), F.col("l_linenumber").cast("string"), F.lit("z")))
    cells = lines.select(F.col("l_orderkey").alias("t"), ((F.col("l_linenumber") - 1) % 2 + 1).alias("r"), F.col("l_linenumber").alias("col"), text.alias("x"))
    return knowledge.row_chunk_ids(knowledge.enrich_rows(chunks, cells, "t", "r", "col", "x"), "t", "r")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'gate_rejected' WHEN event_id % 7 = 0 THEN 'follow_up' WHEN event_id % 5 = 0 THEN 'hybrid' WHEN event_id % 3 = 0 THEN 'formula' WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'semantic_cached' ELSE 'semantic' END ELSE 'structured' END AS category,
  round(event_id / 1000.0 * 0.0001 + (event_id % 100) * 0.00000013 + (event_id % 4) * 0.000001, 9)::DOUBLE AS cost FROM events""")
def request_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What kind of request something was, and what it cost."""
    i = F.col("event_id")
    agent = F.when(i % 3 == 0, "formula").when(i % 3 == 1, "semantic").otherwise("structured")
    agents = F.when(i % 5 == 0, F.array(agent, F.lit("more"))).otherwise(F.array(agent))
    kind = metrics.request_category(F.lit("x"), agents, F.when(F.col("event_type") == "error", "BLOCK").otherwise("PASS"), i % 7 == 0, i % 2 == 0)
    return table(spark, sf, "events").select("event_id", kind.alias("category"), F.round(metrics.request_cost(i, i % 100, i % 4), 9).alias("cost"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AND l_returnflag = 'R' AND (l_linenumber = 4 OR l_quantity <= 10) AS matches, CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_linenumber = 2 THEN 'gold_mismatch' WHEN l_linenumber = 3 THEN 'structured_data' WHEN l_linenumber = 4 THEN 'candidate_generation' WHEN l_linenumber = 5 THEN 'ranking' ELSE 'answer_generation' END AS cause FROM {lines}""".replace("{lines}", _LINES))
def case_results(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a record matches its gold, and why a case failed."""
    n = F.col("l_linenumber")
    gold_value = F.when(n != 4, F.least("l_quantity", F.lit(10.0)))
    match = evaluation.record_matches(n % 2, F.lit(0), F.lower("l_returnflag"), F.lit("R"), F.lit("f"), F.lit("f"), F.col("l_quantity"), gold_value)
    return _numbered(spark, sf).select(*_IDS, match.alias("matches"), evaluation.failure_cause(n == 1, n != 2, n != 3, n != 4, n != 5).alias("cause"))


@query("""WITH s AS (SELECT doc_id, 'semantic:' || doc_id AS query_id, 'Explain ' || coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN source END), ''), 'doc ' || (doc_id % 20)) || '.' AS question, CASE WHEN doc_id % 9 = 0 THEN 'gone' ELSE CAST(doc_id AS VARCHAR) END AS r FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY question) AS k FROM s)
SELECT query_id, question, concat_ws(',', CASE WHEN r = 'gone' THEN 'unknown_id' END, CASE WHEN k > 1 THEN 'repeated_question' END) AS issues FROM n""")
def semantic_case_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about documents, and what is wrong with them."""
    docs = table(spark, sf, "documents")
    chunks = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.concat(F.lit("doc "), (F.col("doc_id") % 20).cast("string")).alias("text"))
    cases = evaluation.semantic_cases(chunks, "doc_id", "title", "text")
    gone = F.split_part("query_id", F.lit(":"), F.lit(2)).cast("long") % 9 == 0
    cases = cases.withColumn("relevant", F.when(gone, F.array(F.lit("gone"))).otherwise(F.col("relevant")))
    return evaluation.case_issues(cases, docs, "doc_id").select("query_id", "question", "issues")


@query("""WITH c AS (SELECT doc_id, source, 'Explain ' || source || '.' AS q FROM documents), s AS (SELECT p_partkey, 'How big is ' || p_name || '?' AS q FROM part)
SELECT p_partkey AS subject, s.q || ' ' || c.q AS question, CASE WHEN p_partkey = doc_id THEN CAST(p_partkey AS VARCHAR) END AS relevant FROM s JOIN c ON p_partkey = doc_id""")
def hybrid_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of both kinds about one subject as one."""
    part, docs = table(spark, sf, "part"), table(spark, sf, "documents")
    left = evaluation.structured_cases(part, "p_partkey", "p_name", {"p_size": "How big is %s?"}).withColumn("subject", F.split_part("query_id", F.lit(":"), F.lit(2)).cast("long"))
    right = evaluation.semantic_cases(docs, "doc_id", "source", "text").withColumn("subject", F.split_part("query_id", F.lit(":"), F.lit(2)).cast("long"))
    return evaluation.hybrid_cases(left, right, "subject").select("subject", "question", F.array_join("relevant", ",").alias("relevant"))


@query("""WITH c AS (SELECT quality, toxic, CASE WHEN quality = 1 THEN 'none' ELSE 'ranking' END AS cause FROM labels) SELECT 'kind' AS what, CAST(toxic AS VARCHAR) AS value, count(*) AS cases, round(avg(CAST(quality AS DOUBLE)), 6) AS quality FROM c GROUP BY toxic
UNION ALL SELECT 'kind', NULL, count(*), round(avg(CAST(quality AS DOUBLE)), 6) FROM c UNION ALL SELECT 'cause', cause, count(*), NULL FROM c GROUP BY cause""")
def case_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Means by kind and over all, and counts by cause."""
    held = table(spark, sf, "labels").withColumn("cause", F.when(F.col("quality") == 1, "none").otherwise("ranking"))
    means, causes = evaluation.summarize(held, "toxic", ["quality"], "cause")
    a = means.select(F.lit("kind").alias("what"), F.col("toxic").cast("string").alias("value"), "cases", "quality")
    return a.unionByName(causes.select(F.lit("cause").alias("what"), F.col("cause").alias("value"), "cases", F.lit(None).cast("double").alias("quality")))


@query("""SELECT l_orderkey AS query, l_linenumber AS rank, l_partkey AS document, round(l_discount / 3, 6) AS score, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 100 ELSE l_linenumber END AS page, l_linestatus = 'O' AND l_returnflag <> 'R' AS kept FROM {lines}""".replace("{lines}", _LINES))
def candidate_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked candidates as they are logged, and which records are promoted."""
    held = _lines(spark, sf, document="l_partkey", score="l_discount / 3", printed="CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 100 END", ok="l_linestatus = 'O'", bad="l_returnflag = 'R'")
    held = held.withColumnsRenamed({"l_orderkey": "query"}).withColumn("rank", F.col("l_linenumber"))
    logged = fusion.candidate_log(held, "l_linenumber", "printed")
    kept = records.promote(held.filter("ok"), F.col("bad")).select("query", "rank", F.lit(True).alias("kept"))
    return logged.join(kept, ["query", "rank"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
