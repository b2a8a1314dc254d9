"""Lookups over canonical rows: only accepted rows of the canonical artifact count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a row canonical.
ACCEPTED, ARTIFACT = "accepted", "canonical_evidence_v1"


def canonical(status: str = "validation_status", artifact: str = "gold_artifact_path") -> Column:
    return (F.col(status) == ACCEPTED) & (F.col(artifact) == ARTIFACT)


def production_scope(source_types: list[str], languages: list[str], document_id=None, excluded_prefix: str = "test_") -> Column:
    """One predicate for all retrieval paths; null embedding, other status or a test id are out of scope."""
    rules = [F.col("source_type").isin(source_types), F.col("validation_status") == ACCEPTED, F.col("embedding").isNotNull(), F.col("language").isin(languages), ~F.startswith(F.col("chunk_id").cast("string"), F.lit(excluded_prefix))]
    if document_id is not None:
        rules.append(F.col("document_id") == document_id)
    return reduce(lambda a, b: a & b, rules)


def scope_violations(rows: DataFrame, scope: Column) -> DataFrame:
    """Rows that were returned though they are out of scope (should be none)."""
    return rows.filter(~F.coalesce(scope, F.lit(False)))


def limits_of(registry: DataFrame, limits: DataFrame, key: str, limit_key: str, order: str, name: str, limit_name: str) -> DataFrame:
    """Registry rows with their limits in key order (null keys last); a limit without a name takes the registry's."""
    joined = registry.join(limits, registry[key] == limits[limit_key])
    place = F.row_number().over(Window.partitionBy(registry[key]).orderBy(F.col(order).asc_nulls_last()))
    return joined.withColumn("position", place).withColumn("shown_name", F.coalesce(F.nullif(F.trim(limit_name), F.lit("")), F.col(name)))


def first_value(rows: DataFrame, by: str, order: str, field: str) -> DataFrame:
    """A field of the first row that has it, else of the first row; with that row's order key."""
    w = Window.partitionBy(by).orderBy(F.col(field).isNull(), F.col(order).asc_nulls_last())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(by, F.col(order).alias("source_key"), F.col(field).alias("value"))


def no_data_reason(subjects: DataFrame, rows: DataFrame, key: str, accepted: Column) -> DataFrame:
    """Why a subject has no answer: NOT_IN_CORPUS, PENDING_PROMOTION, or FOUND."""
    counts = rows.groupBy(key).agg(F.count_if(accepted).alias("accepted"), F.count("*").alias("rows"))
    held = subjects.join(counts, key, "left").fillna(0, ["accepted", "rows"])
    reason = F.when(F.col("accepted") > 0, "FOUND").when(F.col("rows") > 0, "PENDING_PROMOTION").otherwise("NOT_IN_CORPUS")
    return held.withColumn("reason", reason)


def no_data_events(queries: DataFrame, reason: str, query: str) -> DataFrame:
    """Events to append: pending ones only, the query cut to 2,000 characters."""
    return queries.filter(F.col(reason) == "PENDING_PROMOTION").withColumn(query, F.left(query, F.lit(2000)))


def demand(events: DataFrame, by: list[str], keep: Column, limit: int) -> DataFrame:
    return events.filter(keep).groupBy(*by).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), *by).limit(limit)


def duplicate_types(rows: DataFrame, by: str, measures: list[str], key: str) -> DataFrame:
    """(by, measure) that more than one row gives a value for, with the sorted keys of those rows."""
    long = rows.unpivot([by, key], measures, "measure", "value").filter("value is not null")
    keys = F.sort_array(F.collect_list(F.nullif(F.col(key).cast("string"), F.lit(""))))
    return long.groupBy(by, "measure").agg(F.count("*").alias("rows"), F.array_join(keys, ",").alias("keys")).filter("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str, parent_key: str) -> DataFrame:
    """Children with a key that no parent has; null keys point nowhere and aren't orphans."""
    return child.filter(F.col(on).isNotNull()).join(parent.select(F.col(parent_key).alias(on)).distinct(), on, "left_anti")


def evidence_audit(limits: DataFrame, cells: DataFrame, key: str, columns: list[int]) -> DataFrame:
    """Limits joined with their cells: the key `table:row_n:...` names table and row; distinct cells by limit."""
    held = limits.select(key, F.split_part(F.col(key), F.lit(":"), F.lit(1)).alias("table_id"), F.regexp_extract(key, r"row_([0-9]+)", 1).try_cast("int").alias("row_index"))
    joined = held.join(cells.filter(F.col("column_index").isin(columns)), ["table_id", "row_index"], "left")
    return joined.groupBy(key).agg(F.count_distinct("cell_id").alias("cells"))


def molecular_weight(registry: DataFrame, originals: DataFrame, key: str, original: str, stored: str) -> DataFrame:
    """The weight as the source has it, where that parses, else the registry's."""
    from ..functions.numeric import molecular_weight as parse

    held = registry.join(originals.select(key, original), key, "left")
    value = parse(F.col(original)).try_cast("double")
    return held.select(key, F.coalesce(value, F.col(stored)).alias("molecular_weight"), F.when(value.isNotNull(), "original").when(F.col(stored).isNotNull(), "registry").alias("origin"))


def row_text(fields: list[str]) -> Column:
    """`key: value` lines of the fields that have a value."""
    return F.concat_ws("\n", *[F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields])
