"""Review queue: priorities, pages, leases and decisions, kept as an event log.

A task's state is the fold of its events in order; events are only appended, so a job
that runs twice with the same event ids changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of priorities, and how long a claim lasts.
PRIORITIES = ["critical", "high", "medium", "low"]
LEASE = "INTERVAL 30 MINUTES"


def priority_rank(priority: Column) -> Column:
    out = F.when(priority == PRIORITIES[0], 0)
    for i, p in enumerate(PRIORITIES[1:], 1):
        out = out.when(priority == p, i)
    return out.otherwise(len(PRIORITIES))


def priority_of(codes: Column, severities: dict[str, list[str]]) -> Column:
    """The gravest priority any code has; low without."""
    out = None
    for p in PRIORITIES:
        hit = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in severities.get(p, [])]).cast("array<string>"))
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out.otherwise("low")


def queue(tasks: DataFrame, filters: list[Column], order: list[str], offset: int, limit: int, priority: str = "priority") -> DataFrame:
    """A page of the queue, gravest first before paging, so that pages don't depend on the names' alphabet."""
    held = tasks
    for f in filters:
        held = held.filter(f)
    ranked = held.withColumn("priority_rank", priority_rank(F.col(priority)))
    return ranked.orderBy("priority_rank", *order).offset(offset).limit(limit)


def task_states(events: DataFrame, task: str, order: str, kind: str, actor: str, at: str) -> DataFrame:
    """Each task's last decision, its claimer and when the claim ends, by folding its events."""
    ordered = F.sort_array(F.collect_list(F.struct(order, kind, actor, at)))
    start = F.struct(F.lit("OPEN").alias("status"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("timestamp").alias("until"), F.lit(0).alias("version"))

    def step(s: Column, e: Column) -> Column:
        k, t = e[kind], e[at]
        free = s["owner"].isNull() | (s["until"] < t) | (s["owner"] == e[actor])
        open_ = s["status"].isin("OPEN", "CLAIMED")
        claims = (k == "claim") & open_ & free
        decides = k.isin("approve", "reject", "correct") & open_ & (s["owner"] == e[actor]) & (s["until"] >= t)
        status = F.when(claims, "CLAIMED").when((k == "release") & (s["owner"] == e[actor]), "OPEN").when(decides, F.upper(k)).when(k == "reopen", "OPEN").otherwise(s["status"])
        return F.struct(
            status.alias("status"),
            F.when(claims, e[actor]).when(status == "CLAIMED", s["owner"]).otherwise(F.lit(None)).alias("owner"),
            F.when(claims, t + F.expr(LEASE)).when(status == "CLAIMED", s["until"]).otherwise(F.lit(None)).alias("until"),
            (s["version"] + F.when(decides | (k == "reopen"), 1).otherwise(0)).alias("version"),
        )

    return events.groupBy(task).agg(F.aggregate(ordered, start, step).alias("s")).select(task, "s.*")


def expire(states: DataFrame, now: Column) -> DataFrame:
    """Claims whose time is over are open again; `expired` marks them for the log."""
    over = (F.col("status") == "CLAIMED") & (F.col("until") < now)
    return states.withColumn("expired", F.coalesce(over, F.lit(False))).withColumns({"status": F.when(over, "OPEN").otherwise(F.col("status")), "owner": F.when(~F.coalesce(over, F.lit(False)), F.col("owner")), "until": F.when(~F.coalesce(over, F.lit(False)), F.col("until"))})


def upsert_cases(cases: DataFrame, found: DataFrame, key: str, severities: dict[str, list[str]]) -> DataFrame:
    """New issues by idempotency key: new cases open, decided ones reopen as the next version if issues are left."""
    issues = found.groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("codes"))
    fresh = issues.select(F.col(key).alias("_k"), "codes", priority_of(F.col("codes"), severities).alias("_p"))
    both = cases.join(fresh, cases[key] == F.col("_k"), "full_outer")
    known, named = F.col(key).isNotNull(), F.col("_k").isNotNull()
    again = known & named & F.col("status").isin("APPROVE", "REJECT", "CORRECT")
    return both.select(
        F.coalesce(key, "_k").alias(key),
        F.when(~known | again, "OPEN").otherwise(F.col("status")).alias("status"),
        F.when(named, F.col("_p")).otherwise(F.col("priority")).alias("priority"),
        (F.coalesce("version", F.lit(0)) + F.when(~known | again, 1).otherwise(0)).alias("version"),
    )


def apply_corrections(payload: Column, corrections: dict[str, Column]) -> Column:
    """A JSON object with top-level fields replaced; a null correction removes its field."""
    held = F.from_json(payload, "map<string,string>")
    for name, value in corrections.items():
        held = F.map_filter(held, _other(name)) if value is None else F.map_concat(F.map_filter(held, _other(name)), F.create_map(F.lit(name), value.cast("string")))
    return F.to_json(held)


def _other(name: str):
    return lambda k, _: k != name


def open_by_reason(tasks: DataFrame, reason: str) -> DataFrame:
    w = Window.partitionBy(reason)
    return tasks.withColumn("of_reason", F.count("*").over(w))
