"""Reconciliation, merges, versions and range replacement, as whole-table transformations.

Tables are immutable here: each function returns the table's next state, to be written
to a new place and swapped in by one writer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(existing: DataFrame, wanted: DataFrame, review: DataFrame, key: str, fields: list[str], scope: Column | None = None) -> DataFrame:
    """One row per key: INSERT, UPDATE, UNCHANGED, RETIRE or REVIEW, and the fields that differ.

    Null keys never match.  A key under review is REVIEW whatever else is known; rows
    outside `scope` are never retired.
    """
    e = existing.select(F.col(key).alias("_e"), *[F.col(f).alias(f"old_{f}") for f in fields], (scope if scope is not None else F.lit(True)).alias("_in"), F.lit(True).alias("_is_e"))
    w = wanted.select(F.col(key).alias("_w"), F.lit(True).alias("_is_w"), *[F.col(f).alias(f"new_{f}") for f in fields])
    r = review.select(F.col(key).alias("_r")).filter("_r is not null").distinct()
    both = e.join(w, F.col("_e") == F.col("_w"), "full_outer").withColumn(key, F.coalesce("_e", "_w"))
    both = both.join(r, F.col(key) == F.col("_r"), "full_outer").withColumn(key, F.coalesce(key, "_r"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    action = (
        F.when(F.col("_r").isNotNull(), "REVIEW")
        .when(F.col("_is_e").isNull(), "INSERT")
        .when(F.col("_is_w").isNull(), F.when(F.col("_in"), "RETIRE").otherwise("UNCHANGED"))
        .when(F.size(changed) > 0, "UPDATE")
        .otherwise("UNCHANGED")
    )
    return both.select(key, action.alias("action"), F.when(action == "UPDATE", F.array_join(changed, ",")).otherwise("").alias("changed_fields"))


def apply_reconciliation(existing: DataFrame, wanted: DataFrame, plan: DataFrame, key: str, status: str = "validation_status") -> DataFrame:
    """The table after the plan: new and changed rows from `wanted`, retired ones marked, others as they are."""
    act = plan.select(key, "action")
    taken = wanted.join(act.filter(F.col("action").isin("INSERT", "UPDATE")), key, "left_semi")
    gone = act.filter("action = 'RETIRE'").select(key, F.lit(True).alias("_gone"))
    kept = existing.join(act.filter("action = 'UPDATE'"), key, "left_anti").join(gone, key, "left")
    kept = kept.withColumn(status, F.when(F.col("_gone"), "retired").otherwise(F.col(status))).drop("_gone")
    return kept.unionByName(taken, allowMissingColumns=True)


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which: empty for equal sets."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def upsert(target: DataFrame, source: DataFrame, key: str, content: str, derived: list[str]) -> DataFrame:
    """Source rows replace target rows; where the content changed, derived columns become null until made again."""
    old = target.select(F.col(key).alias("_k"), F.sha2(F.col(content).cast("string"), 256).alias("_hash"), *[F.col(c).alias(f"_old_{c}") for c in derived])
    joined = source.join(old, source[key] == F.col("_k"), "left")
    same = F.col("_hash").eqNullSafe(F.sha2(F.col(content).cast("string"), 256))
    columns = [c for c in target.columns if c not in derived]
    fresh = joined.select(*[F.col(c) for c in columns], *[F.when(same, F.col(f"_old_{c}")).alias(c) for c in derived])
    kept = target.join(source.select(key).distinct(), key, "left_anti")
    return kept.select(*columns, *derived).unionByName(fresh)


def fill_missing(target: DataFrame, source: DataFrame, key: str, fields: list[str], generic: dict[str, Column] | None = None) -> DataFrame:
    """Source values where the target has none (or a generic one); target values stay otherwise; new keys are added."""
    s = source.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = target.join(s, target[key] == F.col("_k"), "full_outer")
    weak = lambda f: F.col(f).isNull() | ((generic or {}).get(f, F.lit(False)))
    out = [F.coalesce(target[key], F.col("_k")).alias(key)]
    out += [F.when(F.coalesce(weak(f), F.lit(True)), F.coalesce(F.col(f"_new_{f}"), F.col(f))).otherwise(F.col(f)).alias(f) for f in fields]
    return joined.select(*out)


def retire_stale(rows: DataFrame, active: DataFrame, key: str, status: str, derived: list[str], scope: Column) -> DataFrame:
    """Accepted rows in scope that aren't active become legacy and lose their derived columns."""
    held = rows.join(active.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    stale = F.coalesce(scope, F.lit(False)) & (F.col(status) == "accepted") & F.col("_k").isNull()
    updates = {status: F.when(stale, "legacy").otherwise(F.col(status))} | {c: F.when(~stale, F.col(c)) for c in derived}
    return held.withColumns(updates).drop("_k")


def latest(rows: DataFrame, by: list[str], version: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(version))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_number(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_number"))


def supersede(rows: DataFrame, corrected: DataFrame, by: list[str], version: str = "version", current: str = "is_current") -> DataFrame:
    """Type-2 history: corrected payloads become the next version, their parents stay as history."""
    top = rows.groupBy(*by).agg(F.max(version).alias("_top"))
    fresh = corrected.join(top, by, "left").withColumn(version, (F.coalesce("_top", F.lit(0)) + 1).cast(rows.schema[version].dataType)).withColumn(current, F.lit(True)).drop("_top")
    old = rows.join(corrected.select(*by).distinct().withColumn("_s", F.lit(True)), by, "left")
    old = old.withColumn(current, F.col(current) & F.col("_s").isNull()).drop("_s")
    return old.unionByName(fresh.select(*rows.columns))


def keepers(rows: DataFrame, by: str, canonical: Column, preference: list[Column], key: str) -> DataFrame:
    """Where a group has no canonical row, the one row to keep by preference; canonical rows stay."""
    held = rows.withColumn("_canonical", F.coalesce(canonical, F.lit(False)))
    held = held.withColumn("_any", F.max("_canonical").over(Window.partitionBy(by)))
    w = Window.partitionBy(by).orderBy(*[p.desc() for p in preference], F.desc(key))
    held = held.withColumn("_n", F.row_number().over(w))
    return held.filter("_canonical or (not _any and _n = 1)").drop("_canonical", "_any", "_n")


def replace_range(old: DataFrame, new: DataFrame, page: str, start: int, end: int) -> DataFrame:
    """Old rows outside the pages, and the new ones; rows without a page stay."""
    return old.filter(F.coalesce(~F.col(page).between(start, end), F.lit(True))).unionByName(new)


def distinct_first(rows: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each key."""
    hashed = F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0002")) for k in keys]), 256)
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", hashed).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_key", "_n")


def plan_changes(wanted: DataFrame, existing: DataFrame, key: str, required: list[str]) -> DataFrame:
    """insert or update by idempotency key, with the required fields that are missing."""
    held = wanted.join(existing.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return held.withColumn("operation", F.when(F.col("_k").isNull(), "insert").otherwise("update")).withColumn("missing", F.array_join(missing, ",")).drop("_k")


def inventory(tables: dict[str, DataFrame], status: str) -> DataFrame:
    """Rows by table and status."""
    each = [t.groupBy(F.col(status).cast("string").alias("status")).agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two inventories side by side."""
    b, a = before.withColumnRenamed("rows", "before"), after.withColumnRenamed("rows", "after")
    return b.join(a, ["table", "status"], "full_outer").fillna(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))


def duplicate_positions(rows: DataFrame, position: list[str]) -> DataFrame:
    return rows.groupBy(*position).agg(F.count("*").alias("rows")).filter("rows > 1")
