"""Queries over facts: limits, reconciliation, versions, demand, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import GENERIC_NAMES
from ..operators import gold, quality, reconcile, resolve, review, structured
from .catalogue import query, table

#: lineitem as limits: three measures, each missing on some rows.
_MEASURES = {"quantity": "nullif(l_quantity, 1)", "price": "nullif(l_extendedprice, 0)", "discount": "nullif(l_discount, 0)"}
_LIMITS = "SELECT l_orderkey, l_linenumber, l_partkey, nullif(l_quantity, 1) AS quantity, nullif(l_extendedprice, 0) AS price, nullif(l_discount, 0) AS discount, l_returnflag FROM lineitem"


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(n) for n, e in _MEASURES.items()], "l_returnflag")


@query(f"""WITH l AS ({_LIMITS}) SELECT p_partkey, p_name AS shown_name, l_orderkey, l_linenumber, price,
  row_number() OVER (PARTITION BY p_partkey ORDER BY l_orderkey, l_linenumber) AS position
  FROM part JOIN l ON l_partkey = p_partkey WHERE l_returnflag = 'R'""")
def canonical_limits_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows (flag R) of each part in key order."""
    rows = _limits(spark, sf).filter("l_returnflag = 'R'").withColumn("limit_name", F.lit("")).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = structured.limits_of(table(spark, sf, "part"), rows, "p_partkey", "l_partkey", "key", "p_name", "limit_name")
    return out.select("p_partkey", "shown_name", "l_orderkey", "l_linenumber", "price", "position")


@query("""WITH c AS (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(a, 0) AS accepted, coalesce(n, 0) AS rows, CASE WHEN a > 0 THEN 'FOUND' WHEN n > 0 THEN 'PENDING_PROMOTION' ELSE 'NOT_IN_CORPUS' END AS reason FROM part LEFT JOIN c ON l_partkey = p_partkey""")
def no_data_reason(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return structured.no_data_reason(table(spark, sf, "part").select("p_partkey"), rows, "p_partkey", F.col("l_returnflag") == "R")


@query(f"""WITH l AS ({_LIMITS}), u AS (
  SELECT l_orderkey, l_linenumber, 'quantity' AS measure, CAST(quantity AS DOUBLE) AS value FROM l UNION ALL SELECT l_orderkey, l_linenumber, 'price', price FROM l UNION ALL SELECT l_orderkey, l_linenumber, 'discount', discount FROM l)
SELECT l_orderkey, measure, count(*) AS rows, string_agg(k, ',' ORDER BY k) AS keys FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS k FROM u WHERE value IS NOT NULL) GROUP BY ALL HAVING count(*) > 1""")
def duplicate_limit_types(spark: SparkSession, sf: str) -> DataFrame:
    return structured.duplicate_types(_limits(spark, sf), "l_orderkey", ["quantity", "price", "discount"], "l_linenumber")


@query(f"""WITH l AS ({_LIMITS}) SELECT l_partkey, l_orderkey * 10 + l_linenumber AS source_key, discount AS value FROM l
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY discount IS NULL, l_orderkey * 10 + l_linenumber) = 1""")
def field_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first known discount of each part, else that of its first row."""
    rows = _limits(spark, sf).withColumn("key", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return structured.first_value(rows, "l_partkey", "key", "discount")


@query("SELECT user_id, event_type, count(*) AS requests FROM events WHERE value > 10 GROUP BY ALL ORDER BY requests DESC, user_id, event_type LIMIT 20")
def demand_summary(spark: SparkSession, sf: str) -> DataFrame:
    return structured.demand(table(spark, sf, "events"), ["user_id", "event_type"], F.col("value") > 10, 20)


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def orphan_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "nation").filter("n_regionkey <> 1")
    return structured.orphans(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), parents, "s_nationkey", "n_nationkey").select("s_suppkey", "s_nationkey")


_STATES = """WITH e AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '1-URGENT'),
w AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '5-LOW'),
r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '2-HIGH')
"""


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"), "o_orderpriority")
    wanted = o.filter("o_orderpriority <> '5-LOW'").withColumn("p", F.when(F.col("s") == "F", F.col("p") + 1).otherwise(F.col("p")))
    return o.filter("o_orderpriority <> '1-URGENT'").select("k", "p", "s"), wanted.select("k", "p", "s"), o.filter("o_orderpriority = '2-HIGH'").select("k")


@query(_STATES + """SELECT coalesce(e.k, w.k, r.k) AS k, CASE WHEN r.k IS NOT NULL THEN 'REVIEW' WHEN e.k IS NULL THEN 'INSERT' WHEN w.k IS NULL THEN 'RETIRE'
  WHEN e.p IS DISTINCT FROM w.p OR e.s IS DISTINCT FROM w.s THEN 'UPDATE' ELSE 'UNCHANGED' END AS action,
  CASE WHEN r.k IS NULL AND e.k IS NOT NULL AND w.k IS NOT NULL AND e.p IS DISTINCT FROM w.p THEN 'p' ELSE '' END AS changed_fields
FROM e FULL JOIN w ON e.k = w.k FULL JOIN r ON coalesce(e.k, w.k) = r.k""")
def reconcile_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    e, w, r = _states(spark, sf)
    return reconcile.reconcile(e, w, r, "k", ["p", "s"])


@query(_STATES + "SELECT k, CASE WHEN k IN (SELECT k FROM w) THEN 'right' ELSE 'left' END AS side FROM (SELECT k FROM e UNION SELECT k FROM w) WHERE (k IN (SELECT k FROM e)) <> (k IN (SELECT k FROM w))")
def key_set_difference(spark: SparkSession, sf: str) -> DataFrame:
    e, w, _ = _states(spark, sf)
    return reconcile.same_keys(e, w, "k")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.latest(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next_number FROM lineitem GROUP BY 1")
def next_run_number(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.next_number(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' changed' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents""")
def merge_upsert_hash_change(spark: SparkSession, sf: str) -> DataFrame:
    """Documents upserted by themselves, a third of them changed: derived values go where the content did."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return reconcile.upsert(docs, docs.withColumn("text", changed).drop("n_chars"), "doc_id", "text", ["n_chars"])


_ACCEPTED = "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'rejected' ELSE 'pending' END AS status, toxic, source, n_chars FROM documents d LEFT JOIN labels USING (doc_id)"


def _status(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return held.select("doc_id", status.alias("status"), "toxic", "source", "n_chars")


@query(f"""WITH a AS ({_ACCEPTED}) SELECT doc_id, CASE WHEN status = 'accepted' AND source <> 'src0' AND doc_id % 2 = 1 THEN 'legacy' ELSE status END AS status,
  CASE WHEN status = 'accepted' AND source <> 'src0' AND doc_id % 2 = 1 THEN NULL ELSE n_chars END AS n_chars FROM a""")
def retire_stale_except(spark: SparkSession, sf: str) -> DataFrame:
    rows = _status(spark, sf)
    out = reconcile.retire_stale(rows, rows.filter("doc_id % 2 = 0"), "doc_id", "status", ["n_chars"], F.col("source") != "src0")
    return out.select("doc_id", "status", "n_chars")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1")
def dedupe_records(spark: SparkSession, sf: str) -> DataFrame:
    out = reconcile.distinct_first(table(spark, sf, "documents"), [F.col("lang"), F.col("text")], [F.asc("doc_id")])
    return out.select("doc_id", "lang")


@query(f"""WITH a AS ({_ACCEPTED}), x AS (SELECT *, max(toxic = 1 AND status = 'accepted') OVER (PARTITION BY source, status) AS anyc,
  row_number() OVER (PARTITION BY source, status ORDER BY n_chars DESC, doc_id DESC) AS n FROM a)
SELECT doc_id, source, status FROM x WHERE coalesce(toxic = 1 AND status = 'accepted', false) OR (NOT coalesce(anyc, false) AND n = 1)""")
def keeper_selection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _status(spark, sf).withColumn("grp", F.concat_ws("|", "source", "status"))
    return reconcile.keepers(rows, "grp", (F.col("toxic") == 1) & (F.col("status") == "accepted"), [F.col("n_chars")], "doc_id").select("doc_id", "source", "status")


@query(f"WITH a AS ({_ACCEPTED}) SELECT 'documents' AS \"table\", status, count(*) AS rows FROM a GROUP BY status UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 2")
def inventory_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.inventory({"documents": _status(spark, sf), "orders": table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")}, "status").select("table", "status", "rows")


@query("SELECT event_id, ts FROM events WHERE NOT (event_id BETWEEN 100 AND 199) UNION ALL SELECT event_id, ts + INTERVAL 1 DAY FROM events WHERE event_id BETWEEN 100 AND 199")
def range_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "events").select("event_id", "ts")
    new = old.filter("event_id between 100 and 199").withColumn("ts", F.expr("ts + INTERVAL 1 DAY"))
    return reconcile.replace_range(old, new, "event_id", 100, 199)


@query("""SELECT l_orderkey AS k, CASE WHEN o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS operation, CASE WHEN d IS NULL THEN 'd' ELSE '' END AS missing
FROM (SELECT l_orderkey, nullif(min(l_discount), 0) AS d FROM lineitem GROUP BY 1) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey""")
def change_plan(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.expr("nullif(min(l_discount), 0)").alias("d"))
    existing = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return reconcile.plan_changes(wanted, existing, "k", ["d"]).select("k", "operation", "missing")


_RANKED = "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority, o_orderstatus, o_orderdate FROM orders"


def _tasks(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, sf, "orders").select("o_orderkey", level.alias("priority"), "o_orderstatus", "o_orderdate")


@query(f"""WITH t AS ({_RANKED}) SELECT o_orderkey, priority, CAST(list_position(['critical', 'high', 'medium', 'low'], priority) - 1 AS INTEGER) AS priority_rank FROM t WHERE o_orderstatus = 'O'
ORDER BY priority_rank, o_orderdate, o_orderkey LIMIT 25 OFFSET 50""")
def review_queue_page(spark: SparkSession, sf: str) -> DataFrame:
    out = review.queue(_tasks(spark, sf), [F.col("o_orderstatus") == "O"], ["o_orderdate", "o_orderkey"], 50, 25)
    return out.select("o_orderkey", "priority", "priority_rank")


@query(f"WITH t AS ({_RANKED}) SELECT priority, CAST(list_position(['critical', 'high', 'medium', 'low'], priority) - 1 AS INTEGER) AS priority_rank, count(*) AS tasks FROM t GROUP BY ALL")
def priority_rank_order(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).groupBy("priority", review.priority_rank(F.col("priority")).alias("priority_rank")).agg(F.count("*").alias("tasks"))


@query("""WITH s AS (SELECT event_id, ts, 'CLAIMED' AS status, ts + INTERVAL 30 MINUTE AS until FROM events WHERE event_type = 'click'), n AS (SELECT max(ts) - INTERVAL 1 DAY AS t FROM events)
SELECT event_id, CASE WHEN until < t THEN 'OPEN' ELSE 'CLAIMED' END AS status, until < t AS expired FROM s, n""")
def lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Claims made at each click, as they stand a day before the last event."""
    events = table(spark, sf, "events")
    now = events.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]
    states = events.filter("event_type = 'click'").select("event_id", F.lit("CLAIMED").alias("status"), F.col("event_id").cast("string").alias("owner"), (F.col("ts") + F.expr(review.LEASE)).alias("until"))
    return review.expire(states, F.lit(now)).select("event_id", "status", "expired")


_DECIDES = "kind IN ('approve', 'reject') AND status IN ('OPEN', 'CLAIMED') AND owner IS NOT NULL AND until >= ts"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ts, ['claim', 'approve', 'release', 'claim', 'reject'][event_id % 5 + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 'OPEN' AS status, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS TIMESTAMP) AS until, 0 AS version FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT user_id, i, s, CASE WHEN claims THEN 'reviewer' WHEN s = 'CLAIMED' THEN owner END, CASE WHEN claims THEN ts + INTERVAL 30 MINUTE WHEN s = 'CLAIMED' THEN until END, version + CASE WHEN decides THEN 1 ELSE 0 END FROM (
  SELECT *, CASE WHEN claims THEN 'CLAIMED' WHEN kind = 'release' AND owner IS NOT NULL THEN 'OPEN' WHEN decides THEN upper(kind) ELSE status END AS s FROM (
    SELECT e.user_id, e.i, e.ts, kind, status, owner, until, version, kind = 'claim' AND status IN ('OPEN', 'CLAIMED') AS claims, coalesce({_DECIDES}, false) AS decides FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
SELECT user_id, arg_max(status, i) AS status, arg_max(coalesce(owner, ''), i) AS owner, CAST(arg_max(version, i) AS INT) AS version FROM f GROUP BY user_id""")
def review_task_states(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks (users) folded over their events as claims, releases and decisions."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("claim", "approve", "release", "claim", "reject")]), (F.col("event_id") % 5 + 1).cast("int"))
    events = table(spark, sf, "events").select("user_id", "event_id", kind.alias("kind"), F.lit("reviewer").alias("actor"), "ts")
    return review.task_states(events, "user_id", "event_id", "kind", "actor", "ts").select("user_id", "status", F.coalesce("owner", F.lit("")).alias("owner"), "version")


@query("""WITH n AS (SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[\\s,;:()\\[\\]/\\\\.-]+'), lambda x: x <> ''))), ' ') AS k FROM part)
SELECT k AS token_set, count(*) AS parts FROM n GROUP BY 1 HAVING count(*) > 1""")
def same_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are the same words in any order."""
    from ..functions.text import name_tokens

    held = table(spark, sf, "part").select(F.array_join(F.array_sort(name_tokens("p_name")), " ").alias("token_set"))
    return held.groupBy("token_set").agg(F.count("*").alias("parts")).filter("parts > 1")


_SPLIT = r"list_distinct(list_filter(string_split_regex({}, '[\s,;:()\[\]/\\.-]+'), lambda x: x <> ''))"
_PLAIN = "[" + ", ".join(f"'{w}'" for w in GENERIC_NAMES) + "]"
_SPECIAL = f"list_filter({_SPLIT}, lambda x: NOT list_contains({_PLAIN}, x))"


@query(
    rf"""WITH q AS (SELECT p_partkey AS q, lower(trim(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'limit of ' || p_name END, '\s+', ' ', 'g'))) AS t FROM part),
r AS (SELECT p_partkey AS k, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS n FROM part),
qs AS (SELECT *, list_sort({_SPLIT.format('t')}) AS a, {_SPECIAL.format('t')} AS s, string_split(t, ' ') AS w FROM q), rs AS (SELECT *, list_sort({_SPLIT.format('n')}) AS a, {_SPECIAL.format('n')} AS s FROM r),
runs AS (SELECT DISTINCT q, array_to_string(w[i:i + m], ' ') AS n FROM (SELECT q, w, i, unnest(generate_series(0, least(len(w) - i, 7))) AS m FROM (SELECT q, w, unnest(generate_series(1, len(w))) AS i FROM qs))),
phrases AS (SELECT runs.q, rs.k FROM runs JOIN rs USING (n) WHERE len(rs.s) > 0 QUALIFY rank() OVER (PARTITION BY runs.q ORDER BY length(n) DESC) = 1),
shared AS (SELECT q, k, 0.8::DOUBLE * count(*) / any_value(c) AS score FROM (SELECT q, unnest(s) AS x FROM qs) JOIN (SELECT k, len(s) AS c, unnest(s) AS x FROM rs) USING (x) GROUP BY q, k),
m AS (SELECT q, k, 1.0::DOUBLE AS score, 'exact' AS strategy FROM qs JOIN rs ON t = n UNION ALL SELECT q, k, 0.9, 'token_set' FROM qs JOIN rs ON qs.a = rs.a WHERE len(qs.s) > 0
  UNION ALL SELECT q, k, 0.85, 'phrase' FROM phrases UNION ALL SELECT q, k, score, 'token_overlap' FROM shared WHERE score >= 0.5),
b AS (SELECT q, k, max(score) AS score, arg_max(strategy, score) AS strategy FROM m GROUP BY q, k),
o AS (SELECT *, lead(score) OVER w AS after FROM b WINDOW w AS (PARTITION BY q ORDER BY score DESC, k) QUALIFY row_number() OVER w = 1)
SELECT qs.q, CASE WHEN NOT coalesce(score - after < 0.05, false) THEN k END AS p_partkey, round(score, 6) AS score, strategy, CASE WHEN o.q IS NULL THEN 'NOT_FOUND' WHEN coalesce(score - after < 0.05, false) THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status
FROM qs LEFT JOIN o ON qs.q = o.q"""
)
def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Half-remembered part names to parts: exact, by token set, by phrase, or ambiguous."""
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    asked = part.select(F.col("p_partkey").alias("q"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("limit of "), "p_name")).alias("text"))
    return resolve.resolve(asked, part, "q", "text", "p_partkey", "p_name")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, 'l_returnflag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_linestatus', l_linestatus FROM lineitem)
SELECT field, value, l_orderkey, l_linenumber FROM u WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY field, value ORDER BY l_orderkey, l_linenumber) = 1""")
def entities_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    out = gold.entities(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_returnflag": "flag", "l_linestatus": "status"})
    return out.select("field", "value", "l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, p_name AS subject, predicate, object, CAST(0.95 AS DOUBLE) AS confidence FROM (
  SELECT p_partkey, p_name, 'has_brand' AS predicate, p_brand AS object FROM part UNION ALL SELECT p_partkey, p_name, 'has_type', p_type FROM part UNION ALL SELECT p_partkey, p_name, 'has_size', CAST(p_size AS VARCHAR) FROM part)
WHERE p_name IS NOT NULL AND trim(object) <> ''""")
def knowledge_triples(spark: SparkSession, sf: str) -> DataFrame:
    return gold.triples(table(spark, sf, "part"), ["p_partkey"], "p_name", {"p_brand": "has_brand", "p_type": "has_type", "p_size": "has_size"})


@query("""SELECT p_partkey, field, question, answer FROM (
  SELECT p_partkey, 'p_brand' AS field, 'What is the brand of ' || p_name || '?' AS question, p_brand AS answer FROM part UNION ALL
  SELECT p_partkey, 'p_size', 'What is the size of ' || p_name || '?', CAST(p_size AS VARCHAR) FROM part) WHERE trim(answer) <> ''""")
def question_generation(spark: SparkSession, sf: str) -> DataFrame:
    return gold.questions(table(spark, sf, "part"), ["p_partkey"], "p_name", {"p_brand": "What is the brand of %s?", "p_size": "What is the size of %s?"})


@query("""WITH c AS (SELECT l_orderkey, (l_shipdate IS NOT NULL) AS a, l_quantity > 5 AS b, l_tax > 0.01 AS d FROM lineitem)
SELECT l_orderkey, bool_and(a AND b AND d) AS gold_allowed, concat_ws(',', CASE WHEN NOT bool_and(a) THEN 'dated' END, CASE WHEN NOT bool_and(b) THEN 'quantity' END, CASE WHEN NOT bool_and(d) THEN 'taxed' END) AS issues FROM c GROUP BY 1""")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tables, their lines as rows: all flags must hold on all rows."""
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_shipdate").isNotNull()).alias("a"), F.bool_and(F.col("l_quantity") > 5).alias("b"), F.bool_and(F.col("l_tax") > 0.01).alias("d"))
    gate = quality.table_gate({"dated": F.col("a"), "quantity": F.col("b"), "taxed": F.col("d")})
    return flags.select("l_orderkey", gate.alias("g")).select("l_orderkey", "g.gold_allowed", F.array_join("g.issues", ",").alias("issues"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity_high' END, CASE WHEN l_discount > 0.08 THEN 'discount_high' END, CASE WHEN l_tax < 0.01 THEN 'tax_low' END) AS issues,
  CAST(CASE WHEN l_quantity > 45 THEN 0.0 WHEN l_discount > 0.08 OR l_tax < 0.01 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS score FROM lineitem""")
def validation_issue_array(spark: SparkSession, sf: str) -> DataFrame:
    errors = quality.issue_list({"quantity_high": F.col("l_quantity") > 45})
    warnings = quality.issue_list({"discount_high": F.col("l_discount") > 0.08, "tax_low": F.col("l_tax") < 0.01})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.concat(errors, warnings), ",").alias("issues"), quality.validation_score(errors, warnings).alias("score"))


@query("SELECT l_returnflag AS \"table\", CAST(sum(n) AS BIGINT) AS blocked, string_agg(l_linestatus || '=' || n, ',' ORDER BY l_linestatus) AS reasons FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def blocked_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.blocked_by_table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    text = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select(F.col("l_returnflag").alias("table"), "blocked", text.alias("reasons"))


@query("""WITH l AS (SELECT l_orderkey, l_quantity AS a, 1 + l_linenumber AS t FROM lineitem) SELECT l_orderkey, round(sqrt(sum(a * a * t) / sum(t)), 6) AS exposure FROM l GROUP BY 1""")
def formula_rms_group(spark: SparkSession, sf: str) -> DataFrame:
    """Energy-equivalent exposure of each order's lines."""
    from ..functions.numeric import daily_exposure

    pairs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    value = daily_exposure(F.transform("x", lambda s: s["l_quantity"]), F.transform("x", lambda s: (1 + s["l_linenumber"]).cast("double")))
    return pairs.select("l_orderkey", F.round(value["value"], 6).alias("exposure"))
