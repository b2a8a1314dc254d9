"""Numbers in cells: tokens, slash decimals, units, gates and group formulas.

Three readings of `a/b` are kept apart, each under its own name: `slash_decimal` (a cell
whose parts were swapped: 3/0 is 0.3), `slash_point` (the slash as the point: 3/0 is
3.0) and `slash_quotient` (a division; nothing for a zero divisor).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _string, latin_digits, squeeze

NUMBER = r"[0-9]+(?:[.,/][0-9]+)?"
UNIT = r"ppm|ppb|mg/m3|mg/m³|µg/m3|mg/m|f/cc|%"


def slash_decimal(numerator: Column, denominator: Column) -> Column:
    """`3/0` is 0.3, `0009/0` and `0/0009` are 0.0009, short `a/b` is a.b; else null."""
    return (
        F.when((denominator == "0") & (numerator != ""), F.concat(F.lit("0."), numerator))
        .when((numerator == "0") & denominator.rlike("^[0-9]+$"), F.concat(F.lit("0."), denominator))
        .when((F.length(numerator) <= 2) & (F.length(denominator) == 1), F.concat(numerator, F.lit("."), denominator))
    )


def slash_point(c: Column | str) -> Column:
    """First number, a slash as the point."""
    token = F.regexp_extract(latin_digits(c), r"-?[0-9]+(?:[./][0-9]+)?", 0)
    return F.replace(token, F.lit("/"), F.lit(".")).try_cast("double")


def slash_quotient(c: Column | str) -> Column:
    """All numbers; `a/b` is divided and left out when b is zero."""
    tokens = F.regexp_extract_all(latin_digits(c), F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+(?:\.[0-9]+)?)?"), F.lit(0))

    def value(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, r"\s", ""), "/")
        below = F.get(parts, F.lit(1)).try_cast("double")
        above = F.get(parts, F.lit(0)).try_cast("double")
        return F.when(below.isNull(), above).when(below != 0, above / below)

    return F.array_compact(F.transform(tokens, value))


def primary_token(c: Column | str) -> Column:
    """The last slash token, else the last number before a unit, else the first number."""
    text = latin_digits(c)
    slash = F.regexp_extract_all(text, F.lit(r"[0-9]+/[0-9]+"), F.lit(0))
    unit = F.regexp_extract_all(text, F.lit(rf"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:{UNIT})"), F.lit(1))
    any_ = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    pick = F.when(F.size(slash) > 0, F.element_at(slash, -1)).when(F.size(unit) > 0, F.element_at(unit, -1)).when(F.size(any_) > 0, F.get(any_, F.lit(0)))
    return pick


def normalize_number(token: Column) -> Column:
    """A token as a plain decimal string; null where it can't be read safely."""
    plain = F.when(token.rlike(r"^[0-9]+(?:\.[0-9]+)?$"), token)
    comma = F.when(token.rlike(r"^[0-9]+,[0-9]+$"), F.replace(token, F.lit(","), F.lit(".")))
    parts = F.split(token, "/")
    slash = F.when(token.rlike(r"^[0-9]+/[0-9]+$"), slash_decimal(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    return F.coalesce(plain, comma, slash)


def parse_numeric_cell(c: Column | str) -> Column:
    """struct(original, token, normalized, status, unit): ABSENT, NOT_NUMERIC, VALIDATED or REVIEW_REQUIRED."""
    text = F.trim(_string(c))
    token = primary_token(text)
    value = normalize_number(token)
    unit = F.nullif(F.lower(F.regexp_extract(text, rf"(?i)({UNIT})", 1)), F.lit(""))
    status = (
        F.when(text.isNull() | text.rlike(r"^[-–—\s]*$"), "ABSENT")
        .when(token.isNull() | unit_only(text), "NOT_NUMERIC")
        .when(value.isNull() | F.contains(token, F.lit("/")), "REVIEW_REQUIRED")
        .otherwise("VALIDATED")
    )
    empty = status.isin("ABSENT", "NOT_NUMERIC")
    return F.struct(text.alias("original"), F.when(~empty, token).alias("token"), F.when(~empty, value).alias("normalized"), status.alias("status"), unit.alias("unit"))


def ceiling_from_cell(c: Column | str) -> Column:
    """The value of a cell that reads `C n unit`."""
    return F.nullif(F.regexp_extract(latin_digits(c), rf"(?i)\bC\s*({NUMBER})", 1), F.lit(""))


def collapse_cubic_unit(c: Column | str) -> Column:
    """`mg/m 3` and `mg/m³` as `mg/m3`."""
    return F.regexp_replace(F.replace(_string(c), F.lit("³"), F.lit("3")), r"(?i)(mg\s*/\s*m)\s*3\b", "mg/m3")


def unit_only(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(collapse_cubic_unit(c)), r"mg/m3|ppm|ppb", "")) == ""


def value_unprovable(value: Column, source: Column) -> Column:
    """The value isn't in the source, with spaces and digit forms aside."""
    compact = lambda x: F.regexp_replace(latin_digits(x), r"\s", "")
    return ~F.contains(compact(source), compact(value))


def mixed_row_numbers(c: Column | str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(latin_digits(c), F.lit("[0-9]+"), F.lit(0)))) > 1


def molecular_weight(c: Column | str) -> Column:
    """`85.10`, `85,10`; `10/85` was written from the right and is 85.10."""
    text = F.regexp_replace(latin_digits(c), r"\s", "")
    point = F.nullif(F.regexp_extract(text, r"([0-9]{2,4}[.,][0-9]{1,3})", 1), F.lit(""))
    a, b = F.regexp_extract(text, "([0-9]+)/([0-9]+)", 1), F.regexp_extract(text, "([0-9]+)/([0-9]+)", 2)
    turned = F.when((F.length(a) > 0) & (F.length(b) >= F.length(a)), F.concat(b, F.lit("."), a)).when(F.length(a) > 0, F.concat(a, F.lit("."), b))
    whole = F.nullif(F.regexp_extract(text, r"^([0-9]{2,4})$", 1), F.lit(""))
    return F.coalesce(F.replace(point, F.lit(","), F.lit(".")), turned, whole)


def parse_limits(c: Column | str) -> Column:
    """struct(twa, stel, ceiling, unit) of a segment such as `TWA 5 ppm STEL 10`."""
    text = latin_digits(c)
    named = lambda name: F.nullif(F.regexp_extract(text, rf"(?i){name}\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    return F.struct(named("TWA").alias("twa"), named("STEL").alias("stel"), named(r"(?:CEILING|\bC)").alias("ceiling"), F.nullif(F.lower(F.regexp_extract(text, rf"(?i)({UNIT})", 1)), F.lit("")).alias("unit"))


def numeric_match(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a - b) <= tolerance


def same_value(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null-safe equality of numbers."""
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def daily_exposure(accelerations: Column, hours: Column) -> Column:
    """struct(value, valid, issue): sqrt(sum(a*a*t) / sum(t)) over two arrays; NaN where they can't be used."""
    bad = (
        F.when(F.size(accelerations) != F.size(hours), "length_mismatch")
        .when(F.size(accelerations) <= 0, "empty")
        .when(F.exists(hours, lambda t: t <= 0), "non_positive_time")
    )
    weighted = F.aggregate(F.zip_with(accelerations, hours, lambda a, t: a * a * t), F.lit(0.0), lambda s, x: s + x)
    total = F.aggregate(hours, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.when(bad.isNull(), F.sqrt(weighted / total)).otherwise(F.lit(float("nan"))).alias("value"), bad.isNull().alias("valid"), bad.alias("issue"))


def composite_confidence(ocr: Column, table: Column, schema: Column, threshold: float = 0.65) -> Column:
    """struct(score, passed): 0.4 ocr + 0.35 table + 0.25 schema, or 0.65 and 0.35 without ocr."""
    score = F.when(ocr.isNull(), 0.65 * table + 0.35 * schema).otherwise(0.4 * ocr + 0.35 * table + 0.25 * schema)
    return F.struct(score.alias("score"), (score >= threshold).alias("passed"))


def weakest(*layers: Column) -> Column:
    """The least of the layers that are known; 0 if none is."""
    return F.coalesce(F.least(*layers), F.lit(0.0))


def weakest_or_unknown(*layers: Column) -> Column:
    return F.coalesce(F.least(*layers).cast("string"), F.lit("unknown"))


def review_priority(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "auto").when(confidence >= 0.65, "review").otherwise("high")


def triage_page(text: Column, domain_words: list[str]) -> Column:
    """struct(table, formula, density, persian, kind, confidence) of a page's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum([F.contains(low, F.lit(w)).cast("int") for w in domain_words], F.lit(0))
    table = F.least(hits / 5.0, F.lit(1.0))
    formula = F.least(0.5 * low.rlike(r"=").cast("int") + 0.2 * low.rlike(r"[√∑∫]").cast("int") + 0.3 * low.rlike(r"[a-z]\s*=\s*[a-z0-9(]").cast("int"), F.lit(1.0))
    density = F.least(F.length(low) / 2000.0, F.lit(1.0))
    persian = F.when(F.length(low) > 0, F.regexp_count(low, F.lit("[\u0600-\u06ff]")) / F.length(low)).otherwise(0.0)
    kind = F.when(F.length(squeeze(low)) <= 20, "scanned").when(table >= 0.6, "table").when(formula >= 0.5, "formula").otherwise("text")
    sure = F.when(kind == "table", table).when(kind == "formula", formula).when(kind == "scanned", F.lit(0.9)).otherwise(density)
    return F.struct(table.alias("table"), formula.alias("formula"), density.alias("density"), persian.alias("persian"), kind.alias("kind"), sure.alias("confidence"))
