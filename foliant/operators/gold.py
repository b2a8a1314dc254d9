"""From typed table rows to facts: entities, triples, questions, schema rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import normalize_cas

#: Confidence of each kind of entity, and of triples.
CONFIDENCE = {"name": 0.92, "cas": 0.95, "limit": 0.90, "molecular_weight": 0.88}
TRIPLE_CONFIDENCE, LOW_CONFIDENCE = 0.95, 0.6


def long_fields(rows: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """One row per field that has a value."""
    return rows.select(*ids, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(ids, fields, "field", "value").filter("value is not null and trim(value) <> ''")


def entities(rows: DataFrame, ids: list[str], kinds: dict[str, str]) -> DataFrame:
    """Entities of the fields in `kinds` (field to kind), the first of each kind, value and cell."""
    held = long_fields(rows, ids, list(kinds))
    kind = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    sure = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    held = held.withColumn("kind", kind).withColumn("confidence", F.coalesce(sure[F.col("kind")], F.lit(0.5)))
    w = Window.partitionBy("kind", "value").orderBy(*ids, "field")
    return held.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def triples(rows: DataFrame, ids: list[str], subject: str, predicates: dict[str, str], uncertain: str | None = None) -> DataFrame:
    """(subject, predicate, object, confidence) for each mapped field; rows without a subject have none."""
    keep = [*ids, subject] + ([uncertain] if uncertain else [])
    held = long_fields(rows.filter(F.col(subject).isNotNull()), keep, list(predicates))
    name = F.create_map(*[x for k, v in predicates.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    sure = F.when(F.col(uncertain), LOW_CONFIDENCE).otherwise(TRIPLE_CONFIDENCE) if uncertain else F.lit(TRIPLE_CONFIDENCE)
    return held.select(*ids, F.col(subject).alias("subject"), name.alias("predicate"), F.col("value").alias("object"), sure.alias("confidence"))


def resolve_triples(triples_: DataFrame, cells: DataFrame, cell: str) -> DataFrame:
    """Objects as their cell has them."""
    return triples_.join(cells.select(F.col("cell_id").alias(cell), F.col("text").alias("object_text")), cell, "left")


def questions(rows: DataFrame, ids: list[str], subject: str, templates: dict[str, str]) -> DataFrame:
    """A question and its answer for each field with a template (`%s` is the subject)."""
    held = long_fields(rows.filter(F.col(subject).isNotNull()), [*ids, subject], list(templates))
    text = F.create_map(*[x for k, v in templates.items() for x in (F.lit(k), F.lit(v))])[F.col("field")]
    return held.select(*ids, "field", F.replace(text, F.lit("%s"), F.col(subject)).alias("question"), F.col("value").alias("answer"))


def schema_rows(rows: DataFrame, names: list[str], original: str) -> DataFrame:
    """Rows with their subject: the first name, else the original; those without any are dropped."""
    clean = F.nullif(F.trim(F.regexp_replace(original, r"\s+", " ")), F.lit(""))
    return rows.withColumn("subject", F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], clean)).filter("subject is not null")


def typed_rows(cells: DataFrame, by: list[str], column: str, text: str, names: dict[int, str], header_rows: int = 2) -> DataFrame:
    """Cells to rows with one column for each field; header rows are left out."""
    body = cells.filter(F.col("row_index") >= header_rows)
    picked = [F.max(F.when(F.col(column) == i, F.trim(text))).alias(n) for i, n in names.items()]
    return body.groupBy(*by, "row_index").agg(*picked)


def assemble_limits(cells: DataFrame, by: list[str], columns: dict[int, str], number: str = "cas", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(accepted, for review): a row is accepted if its number is well formed and it has a name."""
    rows = typed_rows(cells, by, "column_index", "text", columns)
    rows = rows.withColumn("number", normalize_cas(F.col(number)))
    good = F.col("number").isNotNull() & (F.coalesce(F.col(name), F.lit("")) != "")
    return rows.filter(good), rows.filter(~F.coalesce(good, F.lit(False)))


def shift_columns(cells: DataFrame, after: int, by: int = 1) -> DataFrame:
    """Columns beyond `after` move on, to make room for one that the scan joined; nothing is invented."""
    return cells.withColumn("column_index", F.when(F.col("column_index") > after, F.col("column_index") + by).otherwise(F.col("column_index")))


def classify_table(text: F.Column) -> F.Column:
    """Ordered rules for a table's family."""
    low = F.lower(text)
    return (
        F.when(low.rlike(r"\b(?:twa|stel|ceiling|oel)\b") | low.rlike(r"[0-9]{2,7}-[0-9]{2}-[0-9]"), "limits")
        .when(low.rlike(r"\b(?:noise|dba|decibel)"), "noise")
        .when(low.rlike(r"\bvibration|\bahv\b"), "vibration")
        .when(low.rlike(r"\b(?:bei|biological|urine|blood)\b"), "biological")
        .when(low.rlike(r"\b(?:article|regulation|shall)\b"), "regulatory")
        .otherwise("unknown")
    )


def formula_candidates(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(page, position, expression) of every `symbol = expression` on a page."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z][A-Za-z0-9_]{0,8}\s*=\s*[^\n=]{1,120})"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("position", "expression")).withColumn("expression", F.trim("expression"))
