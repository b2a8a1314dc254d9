"""Boxes, keys, content hashes and JSON paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the seven columns of a limits table begin, as shares of the page's width.
COLUMN_EDGES = [0.12, 0.25, 0.40, 0.55, 0.72, 0.88]


def _area(b: Column) -> Column:
    return b["width"] * b["height"]


def intersection(a: Column, b: Column) -> Column:
    """Area that two boxes struct(x, y, width, height) share."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller one."""
    small = F.least(_area(a), _area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    shared = intersection(a, b)
    union = _area(a) + _area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def union_box(x0: str, y0: str, x1: str, y1: str) -> Column:
    """Aggregate: the box around all."""
    return F.struct(F.min(x0).alias("x"), F.min(y0).alias("y"), (F.max(x1) - F.min(x0)).alias("width"), (F.max(y1) - F.min(y0)).alias("height"))


def polygon_box(points: Column) -> Column:
    """The box around an array of struct(x, y); null without points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))
    return F.when(F.size(points) > 0, box)


def geometry_gate(box: Column, confidence: Column, least: float = 0.85) -> Column:
    usable = box.isNotNull() & (box["width"] > 0) & (box["height"] > 0)
    return F.when(~F.coalesce(usable, F.lit(False)), "MISSING_BBOX").when(F.coalesce(confidence, F.lit(0.0)) < least, "LOW_CONFIDENCE").otherwise("ACCEPT")


def column_of(x: Column, width: Column, edges: list[float] = COLUMN_EDGES) -> Column:
    """Number of the column in which a centre lies."""
    return sum([(x >= e * width).cast("int") for e in edges], F.lit(0))


def nearest(x: Column, centres: Column) -> Column:
    """Index of the nearest centre, the first of equals."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]


def reading_order(y: Column, x: Column) -> list[Column]:
    """Sort keys: lines of eight points from the top, then from right to left."""
    return [F.bround(y / 8).asc(), x.desc()]


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def range_hash(filename: Column, base: Column, start: Column, end: Column) -> Column:
    return F.sha2(F.format_string("%s:%s:%d-%d", filename, base, start, end), 256)


def cell_key(content: Column, page: Column, table: Column, row: Column, column: Column) -> Column:
    return F.concat_ws(":", content, page.cast("string"), table, row.cast("string"), column.cast("string"))


def task_key(document: Column, version: Column, kind: Column, target: Column) -> Column:
    return F.concat_ws(":", document, version, kind, target)


def cell_page(cell_id: Column) -> Column:
    return F.regexp_extract(cell_id, r"(?:^|[:_])p(?:age)?_?([0-9]+)", 1).try_cast("int")


def printed_or_page(page: Column, printed: Column) -> Column:
    return F.coalesce(printed, page)


def page_values(*pages: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*pages)))


def field_text(key: str, *sources: Column) -> Column:
    """First non-empty value of a key over JSON sources; a nested `value` is unwrapped."""
    found = [F.nullif(F.trim(F.coalesce(F.get_json_object(s, f"$.{key}.value"), F.get_json_object(s, f"$.{key}"))), F.lit("")) for s in sources]
    return F.coalesce(*found)


def display_value(field: Column) -> Column:
    """What a field struct(value, unit, value_status, original_value) shows: nothing if absent, the original if uncertain."""
    shown = F.when(field["value_status"] == "extraction_uncertain", field["original_value"]).otherwise(F.coalesce(field["value"], field["original_value"]))
    return F.when(field["value_status"] == "absent", F.lit(None)).otherwise(F.concat_ws(" ", shown, field["unit"]))


def provenance(document: Column, page: Column, table: Column, cell: Column, original: Column, normalized: Column) -> Column:
    return F.struct(
        document.alias("document_id"),
        F.struct(page.alias("page_number"), table.alias("table_id"), cell.alias("cell_id")).alias("source"),
        F.struct(original.alias("original"), normalized.alias("normalized"), (original != normalized).alias("changed")).alias("value"),
    )


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(c.isNull() | (F.trim(c.cast("string")) == ""), F.lit(name)) for name, c in fields.items()]))
