"""Queries over single cells: text forms, OCR damage, numbers, names and numbers of substances, keys, boxes.

The tables have no cells of the kinds that the functions read, so each row of lineitem is
worded as one of several; the expression that words it is SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity, numeric, text
from ..operators import gold, quality
from .catalogue import query, table

_Q = "CAST(l_quantity AS INT)"
_IDS = ["l_orderkey", "l_linenumber"]


def _cells(spark: SparkSession, sf: str, **words: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*_IDS, *[F.expr(w).alias(n) for n, w in words.items()])


def _worded(**words: str) -> str:
    return "WITH c AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{w} AS {n}" for n, w in words.items()) + " FROM lineitem)"


_FORMS = f"""CASE l_linenumber % 6 WHEN 0 THEN concat('  TWA - ي', {_Q}, '  كa ') WHEN 1 THEN concat('twe of ۱۲', {_Q}, '؟ tw a') WHEN 2 THEN concat('STEL:  ', {_Q}, ' ppm')
  WHEN 3 THEN concat('Ceilling ', {_Q}, ' ABBR limit') WHEN 4 THEN concat('سلام‌ها ', {_Q}, '–X') ELSE concat('Plain  TEXT ', {_Q}) END"""
_DIGITS = "translate({}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_PERSIAN = _DIGITS.format(_SQUEEZE.format("replace(translate(trim({}), 'يكةۀ', 'یکهه'), chr(8204), ' ')"))
_ASKED = _SQUEEZE.format("translate(" + _DIGITS.format("replace({}, chr(8204), ' ')") + ", '؟', '?')")
for _wrong, _right in text.LIMIT_SPELLINGS:
    _ASKED = f"regexp_replace({_ASKED}, '(?i)\\b(?:{_wrong})\\b', '{_right}', 'g')"


@query(
    _worded(cell=_FORMS)
    + rf"""
SELECT l_orderkey, l_linenumber, {_PERSIAN.format('cell')} AS persian_form, regexp_matches(cell, '[\x{{0600}}-\x{{06ff}}]') AS persian, {_ASKED.format('cell')} AS asked,
  trim(regexp_replace(cell, '(?i)^\s*(?:TWA|STEL|CEILING|OEL|TLV)\b[\s:/-]*', '')) AS bare, regexp_replace({_ASKED.format('cell')}, '(?i)\bABBR\b', 'abbreviated', 'g') AS expanded,
  lower({_SQUEEZE.format(_PERSIAN.format(r"regexp_replace(translate(cell, '–', '-'), '[\x{200b}-\x{200f}\x{feff}]', '', 'g')"))}) AS canonical, left(cell, 5) AS snippet FROM c"""
)
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Letters, digits, spaces and limit names in their one form."""
    c = F.col("cell")
    return _cells(spark, sf, cell=_FORMS).select(
        *_IDS,
        text.normalize_persian_text(c).alias("persian_form"),
        text.contains_persian(c).alias("persian"),
        text.normalize_query(c).alias("asked"),
        text.strip_limit_prefix(c).alias("bare"),
        text.expand_abbreviations(c, {"ABBR": "abbreviated"}).alias("expanded"),
        text.canonical_text(c).alias("canonical"),
        text.snippet(c, 5).alias("snippet"),
    )


_DAMAGE = f"""CASE l_linenumber % 6 WHEN 0 THEN concat('ch e m ic al limit ', {_Q}, ' , see table') WHEN 1 THEN concat('71-43-2 | ', {_Q}, ' ppm | 3 4 5 ') WHEN 2 THEN concat('A B C D ', {_Q})
  WHEN 3 THEN concat('The limit for the substance is ', {_Q}, ' ppm.') WHEN 4 THEN 'TWA and STEL of substances ;in air' ELSE concat('short ', {_Q}) END"""
_JOINED = "array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_full_match(x, '[A-Za-z]{1,2}') AND regexp_full_match(w[i - 1], '[A-Za-z]{1,2}') THEN x ELSE ' ' || x END), '')"
_SPACED = _SQUEEZE.format(r"regexp_replace(regexp_replace({}, '[ \t]+([,.;:!?])', '\1', 'g'), '([,;!?])([^\s\d,.;:!?])', '\1 \2', 'g')")
_RUNS = r"regexp_extract_all(cell, '\b[A-Za-z]{1,2}(?:\s[A-Za-z]{1,2}){2,}\b')"
_CONFIRMED = rf"len(list_filter({_RUNS}, lambda x: length(regexp_replace(x, '\s', '', 'g')) BETWEEN 4 AND 24))"
_POSSIBLE = r"len(regexp_extract_all(cell, '\b[A-Za-z]\s[A-Za-z]\s[A-Za-z]\b'))"
_ROW = r"""(CAST(regexp_matches(cell, '[0-9]{2,7}\s*-\s*[0-9]{2}\s*-\s*[0-9]') AS INT) + CAST(regexp_matches(cell, '(?i)[0-9]\s*(?:ppm|mg/m)') AS INT) + CAST(regexp_matches(cell, '(?:[0-9]+(?:[./][0-9]+)?\s+){2,}') AS INT) + CAST(regexp_matches(cell, '\|.*\|') AS INT)) >= 2"""


@query(
    _worded(cell=_DAMAGE)
    + rf""", d AS (SELECT *, string_split({_SQUEEZE.format('cell')}, ' ') AS w FROM c)
SELECT l_orderkey, l_linenumber, {_JOINED} AS joined, {_SPACED.format(_JOINED)} AS repaired, CAST({_CONFIRMED} AS INT) AS confirmed, CAST({_POSSIBLE} AS INT) AS possible, {_SPACED.format('cell')} AS marks,
  {_ROW} AS table_row, (CAST(contains(lower(cell), 'twa') AS INT) + CAST(contains(lower(cell), 'stel') AS INT) + CAST(contains(lower(cell), 'cas') AS INT)) >= 2 AND length(cell) < 180 AS header,
  {_CONFIRMED} > 0 AS broken, length(cell) < 30 OR regexp_matches(cell, '^[\x00-\x7F]{{1,12}}$') AS fragment,
  {_CONFIRMED} > 0 OR {_POSSIBLE} >= 3 OR len(regexp_extract_all(cell, '\s')) > 0.4 * length(cell) AS malformed,
  length(trim(cell)) < 20 OR NOT regexp_matches(trim(cell), '[.!?:;)\]»"'']$') AS incomplete FROM d"""
)
def ocr_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Letters apart, marks, table rows and headers, damaged and incomplete texts."""
    c = F.col("cell")
    return _cells(spark, sf, cell=_DAMAGE).select(
        *_IDS,
        text.join_fragments(c).alias("joined"),
        text.repair_ocr(c).alias("repaired"),
        text.confirmed_fragments(c).alias("confirmed"),
        text.possible_fragments(c).alias("possible"),
        text.spaced_marks(c).alias("marks"),
        text.looks_like_table_row(c).alias("table_row"),
        text.looks_like_table_header(c, ["TWA", "STEL", "CAS"]).alias("header"),
        text.broken_text(c).alias("broken"),
        text.is_fragment(c).alias("fragment"),
        text.malformed(c).alias("malformed"),
        text.incomplete_sentence(c).alias("incomplete"),
    )


_BEFORE = f"concat('limit of benzene ', {_Q}, ' ppm at 71-43-2')"
_AFTER = f"""CASE l_linenumber % 4 WHEN 0 THEN concat('limit of the benzene ', {_Q}, ' ppm at 71-43-2') WHEN 1 THEN concat('limit of benzene ', {_Q}, ' ppm at 71-43-2 !') WHEN 2 THEN concat('limit of benzene ', {_Q} + 1, ' ppm at 71-43-2') ELSE concat('LIMIT of  benzene ', {_Q}) END"""
_WORDS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^\w\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1))"
_COVER = f"(CAST(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) AS DOUBLE) / len({_WORDS.format('b')}))"


def _same(pattern: str) -> str:
    return f"regexp_extract_all(a, '{pattern}') = regexp_extract_all(b, '{pattern}')"


@query(
    _worded(a=_BEFORE, b=_AFTER)
    + rf""", h AS (SELECT *, list_max(list_filter(generate_series(0, least(length(a), length(b))), lambda i: left(a, CAST(i AS INT)) = left(b, CAST(i AS INT)))) AS head FROM c),
t AS (SELECT *, list_max(list_filter(generate_series(0, least(length(a), length(b)) - head), lambda i: right(a, CAST(i AS INT)) = right(b, CAST(i AS INT)) OR i = 0)) AS tail FROM h),
v AS (SELECT *, {_same('[0-9]+(?:[./][0-9]+)?')} AND {_same(r'[0-9]{2,7}\s*-\s*[0-9]{2}\s*-\s*[0-9]')} AND {_same('[A-Za-z]{2,}')} AS kept, abs(len(string_split({_SQUEEZE.format('a')}, ' ')) - len(string_split({_SQUEEZE.format('b')}, ' '))) <= 3 AND length(b) <= 2 * length(a) + 15 AS sane FROM t)
SELECT l_orderkey, l_linenumber, CAST(head AS INT) AS start, substr(a, CAST(head AS INT) + 1, CAST(length(a) - head - tail AS INT)) AS removed, substr(b, CAST(head AS INT) + 1, CAST(length(b) - head - tail AS INT)) AS added,
  contains({_SQUEEZE.format('lower(a)')}, {_SQUEEZE.format('lower(b)')}) AS covered, round({_COVER}, 6) AS coverage,
  contains({_SQUEEZE.format('lower(a)')}, {_SQUEEZE.format('lower(b)')}) OR contains({_SQUEEZE.format('lower(b)')}, {_SQUEEZE.format('lower(a)')}) OR {_COVER} >= 0.45 AS overlaps,
  substr(a, 1, 6) || 'for' || substr(a, 9) AS edited, CASE WHEN NOT kept OR NOT sane OR 0.8 < 0.7 THEN 'REJECT' WHEN 0.8 < 0.9 THEN 'REVIEW' ELSE 'ACCEPT' END AS verdict,
  CASE WHEN contains({_SQUEEZE.format('lower(a)')}, {_SQUEEZE.format('lower(b)')}) THEN a ELSE a || chr(10) || b END AS appended FROM v"""
)
def repair_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What a repair changed, whether it may be applied, and what another text has already."""
    a, b = F.col("a"), F.col("b")
    middle = text.changed_middle(a, b)
    return _cells(spark, sf, a=_BEFORE, b=_AFTER).select(
        *_IDS,
        middle["start"].alias("start"),
        middle["removed"].alias("removed"),
        middle["added"].alias("added"),
        text.already_covered(b, a).alias("covered"),
        F.round(text.token_coverage(a, b), 6).alias("coverage"),
        text.text_overlaps(a, b).alias("overlaps"),
        text.apply_edits(a, F.array(F.struct(F.lit(6).alias("start"), F.lit(8).alias("end"), F.lit("for").alias("new")))).alias("edited"),
        text.validate_repair(a, b, F.lit(0.8)).alias("verdict"),
        text.append_uncovered(F.array(a, b)).alias("appended"),
    )


_NUMBERS = f"""CASE l_linenumber % 7 WHEN 0 THEN concat({_Q}, '/', l_linenumber, ' mg/m 3') WHEN 1 THEN concat('C ', {_Q}, ' ppm') WHEN 2 THEN concat('TWA ', {_Q}, '.5 ppm STEL: ', {_Q} + 9, ' CEILING=7') WHEN 3 THEN concat({_Q}, ',25 ppm') WHEN 4 THEN 'mg/m³'
  WHEN 5 THEN concat({_Q}, '/0 and ', {_Q}, '/2') ELSE concat('85.10 or ', {_Q}) END"""
_FIRST = r"nullif(regexp_extract(cell, '{}', {}), '')"
_PARTS = r"list_transform(regexp_extract_all(cell, '-?[0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+(?:\.[0-9]+)?)?'), lambda t: string_split(regexp_replace(t, '\s', '', 'g'), '/'))"
_UNITS = "ppm|ppb|mg/m3|mg/m³|µg/m3|mg/m|f/cc|%"
_COLLAPSED = r"regexp_replace(replace({}, '³', '3'), '(?i)(mg\s*/\s*m)\s*3\b', 'mg/m3', 'g')"
_TIGHT = r"regexp_replace(cell, '\s', '', 'g')"


@query(
    _worded(cell=_NUMBERS)
    + rf""", n AS (SELECT *, regexp_extract_all(cell, '[0-9]+/[0-9]+') AS s, regexp_extract_all(cell, '(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:{_UNITS})', 1) AS u, regexp_extract_all(cell, '[0-9]+(?:[.,/][0-9]+)?') AS o FROM c),
p AS (SELECT *, CASE WHEN len(s) > 0 THEN s[-1] WHEN len(u) > 0 THEN u[-1] WHEN len(o) > 0 THEN o[1] END AS token FROM n),
z AS (SELECT *, split_part(token, '/', 1) AS x, split_part(token, '/', 2) AS y, regexp_extract({_TIGHT}, '([0-9]+)/([0-9]+)', 1) AS wa, regexp_extract({_TIGHT}, '([0-9]+)/([0-9]+)', 2) AS wb FROM p)
SELECT l_orderkey, l_linenumber, TRY_CAST(replace(regexp_extract(cell, '-?[0-9]+(?:[./][0-9]+)?'), '/', '.') AS DOUBLE) AS point,
  array_to_string(list_transform(list_filter(list_transform({_PARTS}, lambda t: CASE WHEN len(t) < 2 THEN CAST(t[1] AS DOUBLE) WHEN CAST(t[2] AS DOUBLE) <> 0 THEN CAST(t[1] AS DOUBLE) / CAST(t[2] AS DOUBLE) END), lambda v: v IS NOT NULL), lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ',') AS quotients,
  token, CASE WHEN regexp_full_match(token, '[0-9]+(\.[0-9]+)?') THEN token WHEN regexp_full_match(token, '[0-9]+,[0-9]+') THEN replace(token, ',', '.') WHEN regexp_full_match(token, '[0-9]+/[0-9]+') THEN
    CASE WHEN regexp_full_match(y, '0+') AND length(y) = 1 THEN '0.' || x WHEN x = '0' THEN '0.' || y WHEN length(x) <= 2 AND length(y) <= 1 THEN x || '.' || y END END AS normalized,
  {_FIRST.format('(?i)\\bC\\s*([0-9]+(?:[.,/][0-9]+)?)', 1)} AS ceiling, {_COLLAPSED.format('cell')} AS collapsed, trim(regexp_replace(lower({_COLLAPSED.format('cell')}), 'mg/m3|ppm|ppb', '', 'g')) = '' AS unit_only,
  NOT contains({_TIGHT}, '85.10') AS unprovable, len(list_distinct(regexp_extract_all(cell, '[0-9]+'))) > 1 AS mixed,
  coalesce(replace(nullif(regexp_extract({_TIGHT}, '([0-9]{{2,4}}[.,][0-9]{{1,3}})', 1), ''), ',', '.'), CASE WHEN length(wa) > 0 AND length(wb) >= length(wa) THEN wb || '.' || wa WHEN length(wa) > 0 THEN wa || '.' || wb END, nullif(regexp_extract({_TIGHT}, '^([0-9]{{2,4}})$', 1), '')) AS weight,
  CAST({_FIRST.format('(?i)TWA\\s*[:=]?\\s*([0-9]+(?:\\.[0-9]+)?)', 1)} AS DOUBLE) AS twa, CAST({_FIRST.format('(?i)STEL\\s*[:=]?\\s*([0-9]+(?:\\.[0-9]+)?)', 1)} AS DOUBLE) AS stel, CAST({_FIRST.format('(?i)(?:CEILING|\\bC)\\s*[:=]?\\s*([0-9]+(?:\\.[0-9]+)?)', 1)} AS DOUBLE) AS top,
  nullif(lower(regexp_extract(cell, '(?i)({_UNITS})', 1)), '') AS unit FROM z"""
)
def number_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The readings of a cell's number that have names of their own."""
    c = F.col("cell")
    limits = numeric.parse_limits(c)
    quotients = F.transform(numeric.slash_quotient(c), lambda v: F.round(v * 1000).cast("long").cast("string"))
    return _cells(spark, sf, cell=_NUMBERS).select(
        *_IDS,
        numeric.slash_point(c).alias("point"),
        F.array_join(quotients, ",").alias("quotients"),
        numeric.primary_token(c).alias("token"),
        numeric.normalize_number(numeric.primary_token(c)).alias("normalized"),
        numeric.ceiling_from_cell(c).alias("ceiling"),
        numeric.collapse_cubic_unit(c).alias("collapsed"),
        numeric.unit_only(c).alias("unit_only"),
        numeric.value_unprovable(F.lit("85.10"), c).alias("unprovable"),
        numeric.mixed_row_numbers(c).alias("mixed"),
        numeric.molecular_weight(c).alias("weight"),
        limits["twa"].alias("twa"),
        limits["stel"].alias("stel"),
        limits["ceiling"].alias("top"),
        limits["unit"].alias("unit"),
    )


_A, _B = "CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END", "CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END"


@query(
    _worded(a=_A, b=_B)
    + """
SELECT l_orderkey, l_linenumber, abs(a - b) <= 0.01 AS near, coalesce(a IS NOT DISTINCT FROM b OR abs(a - b) <= 0.000000001, false) AS same, coalesce(least(a, b), 0) AS weakest, least(a, b) IS NULL AS unknown,
  CASE WHEN 10 * a >= 0.85 THEN 'auto' WHEN 10 * a >= 0.65 THEN 'review' ELSE 'high' END AS priority, CASE WHEN b IS NULL THEN round(0.65 * 0.5 + 0.35 * l_linenumber / 7, 6) ELSE round(0.4 * b + 0.35 * 0.5 + 0.25 * l_linenumber / 7, 6) END AS score FROM c"""
)
def value_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison with tolerance, null-safe equality, the weakest layer, priority by confidence."""
    a, b = F.col("a"), F.col("b")
    return _cells(spark, sf, a=_A, b=_B).select(
        *_IDS,
        numeric.numeric_match(a, b, 0.01).alias("near"),
        numeric.same_value(a, b).alias("same"),
        numeric.weakest(a, b).alias("weakest"),
        (numeric.weakest_or_unknown(a, b) == "unknown").alias("unknown"),
        numeric.review_priority(10 * a).alias("priority"),
        F.round(numeric.composite_confidence(b, F.lit(0.5), F.col("l_linenumber") / 7)["score"], 6).alias("score"),
    )


_NAMES = f"""CASE l_linenumber % 6 WHEN 0 THEN concat('Benzene (71-43-2), Toluene 108 - 88 - 3 no ', {_Q}) WHEN 1 THEN 'dust and fumes' WHEN 2 THEN concat('Acid,  Nitric [7697-37-2] ', {_Q}) WHEN 3 THEN '' WHEN 4 THEN concat('xylene, o- ', {_Q}) ELSE concat('limit STEL of acetone for ', {_Q}, ' ppm') END"""
_CAS = r"[0-9]{2,7}\s*-\s*[0-9]{2}\s*-\s*[0-9]"
_CASES = rf"list_transform(regexp_extract_all(cell, '{_CAS}'), lambda x: regexp_replace(x, '\s', '', 'g'))"
_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(cell), '[\s,;:()\[\]/\\.-]+'), lambda x: x <> ''))"
_GENERIC = "[" + ", ".join(f"'{w}'" for w in identity.GENERIC_NAMES) + "]"


def _unique(values: str) -> str:
    """Distinct values of a list in order of first appearance."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


_BARE = r"regexp_replace(s, '\([^)]*\)|\[[^\]]*\]', ' ', 'g')"
_VARIANTS = f"list_filter([s, lower(s), {_SQUEEZE.format(_BARE)}, regexp_replace(s, '^([^,]+),\\s*(.+)$', '\\2 \\1'), replace(s, '-', ' ')], lambda x: x <> '')"


@query(
    _worded(cell=_NAMES)
    + rf""", d AS (SELECT *, {_SQUEEZE.format('cell')} AS s, {_CASES} AS n FROM c), e AS (SELECT *, {_VARIANTS} AS v, list_filter(regexp_extract_all(lower(cell), '[a-z][a-z0-9-]+'), lambda x: x NOT IN ('limit', 'of', 'for')) AS w FROM d)
SELECT l_orderkey, l_linenumber, n[1] AS cas, array_to_string({_unique('n')}, ',') AS every, CASE WHEN regexp_matches(cell, '^[0-9]{{2,7}}-[0-9]{{2}}-[0-9]$') THEN '' ELSE 'cas_format' END AS issues, CASE WHEN regexp_matches(cell, '[0-9]') THEN '' ELSE 'exposure_value' END AS exposure,
  lower(s) AS name, len(list_filter({_TOKENS}, lambda t: NOT list_contains({_GENERIC}, t))) = 0 AS generic, array_to_string({_unique('v')}, '|') AS variants,
  concat_ws(',', CASE WHEN regexp_matches(cell, '(?i)stel') THEN 'short' END, CASE WHEN regexp_matches(cell, '(?i)ppm') THEN 'unit' END) AS fields, array_to_string({_unique('w')}, ',') AS words,
  contains(lower(cell), 'nitric') OR contains(lower(cell), 'xylene') AS matched FROM e"""
)
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Registry numbers, generic names, search variants, requested fields, name words."""
    c = F.col("cell")
    join = lambda a, by=",": F.array_join(a, by)
    return _cells(spark, sf, cell=_NAMES).select(
        *_IDS,
        identity.normalize_cas(c).alias("cas"),
        join(identity.extract_cas(c)).alias("every"),
        join(identity.cas_issues(c)).alias("issues"),
        join(identity.exposure_issues(c, F.lit("ppm"))).alias("exposure"),
        identity.normalize_name(c).alias("name"),
        identity.is_generic(c).alias("generic"),
        join(identity.search_variants(c), "|").alias("variants"),
        join(identity.requested_fields(c, {"short": "stel", "unit": "ppm"})).alias("fields"),
        join(identity.query_name_tokens(c, ["limit", "of", "for"])).alias("words"),
        identity.name_pattern_match(c, F.array(F.lit("Nitric"), F.lit("XYLENE"))).alias("matched"),
    )


_MIXED = "CASE l_linenumber % 4 WHEN 0 THEN 'Benzene 71-43-2; Toluene 108-88-3' WHEN 1 THEN 'Acetone' WHEN 2 THEN concat('dust 14808-60-7 ', l_linenumber) ELSE 'Nitric acid [7697-37-2]' END"


@query(
    _worded(cell=_MIXED)
    + rf""", n AS (SELECT *, regexp_extract_all(cell, '{_CAS}') AS numbers, string_split_regex(cell, '{_CAS}') AS names FROM c),
s AS (SELECT l_orderkey, l_linenumber, unnest(generate_series(1, greatest(len(numbers), 1))) AS i, cell, numbers, names FROM n)
SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INT) AS place, CASE WHEN len(numbers) = 0 THEN trim(cell) ELSE trim(regexp_replace(names[i], '[\[\](),;\n]+', ' ', 'g')) END AS name, numbers[i] AS cas,
  len(numbers) = 0 OR len(list_filter(list_distinct(list_filter(string_split_regex(lower(regexp_replace(names[i], '[\[\](),;\n]+', ' ', 'g')), '[\s,;:()\[\]/\\.-]+'), lambda x: x <> '')), lambda t: NOT list_contains({_GENERIC}, t))) = 0 AS review FROM s"""
)
def cell_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of several substances split by their registry numbers."""
    held = _cells(spark, sf, cell=_MIXED).select(*_IDS, F.posexplode(identity.entities(F.col("cell"))).alias("place", "e"))
    return held.select(*_IDS, "place", "e.name", "e.cas", "e.review")


_BOX = {"x": "l_quantity", "y": "CAST(l_linenumber AS DOUBLE)", "w": "l_quantity / 2", "h": "10 * l_discount", "k": "CAST(l_orderkey % 20 AS DOUBLE)"}
_SHARED = "greatest(least(x + w, k + 20) - greatest(x, k), 0) * greatest(least(y + h, 6) - greatest(y, 1), 0)"


@query(
    _worded(**_BOX)
    + f""", s AS (SELECT *, {_SHARED} AS shared, w * h AS a FROM c)
SELECT l_orderkey, l_linenumber, round(CASE WHEN least(a, 100) > 0 THEN shared / least(a, 100) ELSE 0 END, 6) AS overlap, round(CASE WHEN a + 100 - shared > 0 THEN shared / (a + 100 - shared) ELSE 0 END, 6) AS iou,
  CASE WHEN NOT (w > 0 AND h > 0) THEN 'MISSING_BBOX' WHEN k / 20 < 0.85 THEN 'LOW_CONFIDENCE' ELSE 'ACCEPT' END AS gate,
  CAST(x >= 6 AS INT) + CAST(x >= 12.5 AS INT) + CAST(x >= 20 AS INT) + CAST(x >= 27.5 AS INT) + CAST(x >= 36 AS INT) + CAST(x >= 44 AS INT) AS col,
  CASE WHEN abs(5 - x) <= abs(20 - x) AND abs(5 - x) <= abs(40 - x) THEN 0 WHEN abs(20 - x) <= abs(40 - x) THEN 1 ELSE 2 END AS nearest,
  least(x, k) AS box_x, least(y, h) AS box_y, greatest(x, k) - least(x, k) AS box_w, greatest(y, h) - least(y, h) AS box_h FROM s"""
)
def box_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of boxes, the gate for cells, columns by edge and by centre, the box of a polygon."""
    b = _cells(spark, sf, **_BOX)
    mine = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    other = F.struct(F.col("k").alias("x"), F.lit(1.0).alias("y"), F.lit(20.0).alias("width"), F.lit(5.0).alias("height"))
    around = geometry.polygon_box(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("k").alias("x"), F.col("h").alias("y"))))
    return b.select(
        *_IDS,
        F.round(geometry.overlap_ratio(mine, other), 6).alias("overlap"),
        F.round(geometry.iou(mine, other), 6).alias("iou"),
        geometry.geometry_gate(mine, F.col("k") / 20).alias("gate"),
        geometry.column_of(F.col("x"), F.lit(50.0)).alias("col"),
        geometry.nearest(F.col("x"), F.array(F.lit(5.0), F.lit(20.0), F.lit(40.0))).alias("nearest"),
        around["x"].alias("box_x"),
        around["y"].alias("box_y"),
        around["width"].alias("box_w"),
        around["height"].alias("box_h"),
    )


@query("""SELECT l_orderkey, min(l_quantity) AS x, min(l_tax) AS y, round(max(l_quantity) - min(l_quantity), 6) AS width, round(max(l_tax) - min(l_tax), 6) AS height, string_agg(l_linenumber, ',' ORDER BY round_even(l_quantity / 8, 0), l_extendedprice DESC) AS in_order FROM lineitem GROUP BY 1""")
def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The box around an order's lines, and their reading order from the top and right."""
    from pyspark.sql import Window

    lines = table(spark, sf, "lineitem")
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*geometry.reading_order(F.col("l_quantity"), F.col("l_extendedprice")))))
    box = geometry.union_box("l_quantity", "l_tax", "l_quantity", "l_tax")
    order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "l_linenumber"))), lambda s: s["l_linenumber"].cast("string")), ",")
    return placed.groupBy("l_orderkey").agg(box.alias("b"), order.alias("in_order")).select("l_orderkey", "b.x", "b.y", F.round("b.width", 6).alias("width"), F.round("b.height", 6).alias("height"), "in_order")


_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'extraction_uncertain' ELSE 'present' END"
_JSON = """concat('{"twa": {"value": "', l_linenumber, '"}, "name": "', l_returnflag, '", "blank": " "}')"""


@query(
    _worded(cell_id="concat('doc:p_', l_linenumber, ':c')", st=_STATUS, val="CASE WHEN l_linenumber <> 2 THEN l_returnflag END", body=_JSON)
    + """
SELECT l_orderkey, l_linenumber, concat_ws(':', 'h', CAST(l_linenumber AS VARCHAR), 't', CAST(l_orderkey AS VARCHAR), '0') AS cell_key, concat_ws(':', 'd', 'v1', 'kind', cell_id) AS task_key, sha256('f:b:' || l_linenumber || '-' || (l_linenumber + 2)) AS range_hash,
  l_linenumber AS page, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 100 END, l_linenumber) AS printed, CASE WHEN l_linenumber % 2 = 0 THEN concat(l_linenumber, ',', l_linenumber + 100) ELSE CAST(l_linenumber AS VARCHAR) END AS pages,
  CAST(l_linenumber AS VARCHAR) AS twa, substr(body, position('"name": "' IN body) + 9, 1) AS flag, CASE st WHEN 'absent' THEN NULL WHEN 'extraction_uncertain' THEN 'orig ppm' ELSE concat_ws(' ', coalesce(val, 'orig'), 'ppm') END AS shown,
  concat_ws(',', CASE WHEN val IS NULL THEN 'val' END, CASE WHEN st = 'absent' THEN 'state' END) AS missing, l_linenumber || '/' || cell_id || '/' || CAST(st <> 'present' AS VARCHAR) AS origin FROM c"""
)
def keys_and_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of cells and tasks, pages, fields of JSON sources, what a field shows, what is missing, provenance."""
    c = _cells(spark, sf, cell_id="concat('doc:p_', l_linenumber, ':c')", st=_STATUS, val="CASE WHEN l_linenumber <> 2 THEN l_returnflag END", body=_JSON)
    n = F.col("l_linenumber")
    printed = F.when(n % 2 == 0, n + 100)
    field = F.struct(F.col("val").alias("value"), F.lit("ppm").alias("unit"), F.col("st").alias("value_status"), F.lit("orig").alias("original_value"))
    chain = geometry.provenance(F.lit("d"), n, F.lit("t"), F.col("cell_id"), F.col("st"), F.lit("present"))
    return c.select(
        *_IDS,
        geometry.cell_key(F.lit("h"), n, F.lit("t"), F.col("l_orderkey"), F.lit(0)).alias("cell_key"),
        geometry.task_key(F.lit("d"), F.lit("v1"), F.lit("kind"), F.col("cell_id")).alias("task_key"),
        geometry.range_hash(F.lit("f"), F.lit("b"), n, n + 2).alias("range_hash"),
        geometry.cell_page(F.col("cell_id")).alias("page"),
        geometry.printed_or_page(n, printed).alias("printed"),
        F.array_join(F.transform(geometry.page_values(n, printed), lambda x: x.cast("string")), ",").alias("pages"),
        geometry.field_text("twa", F.lit("{}"), F.col("body")).alias("twa"),
        geometry.field_text("name", F.col("body")).alias("flag"),
        geometry.display_value(field).alias("shown"),
        F.array_join(geometry.missing_fields({"val": F.col("val"), "state": F.nullif(F.col("st"), F.lit("absent"))}), ",").alias("missing"),
        F.concat_ws("/", chain["source"]["page_number"].cast("string"), chain["source"]["cell_id"], chain["value"]["changed"].cast("string")).alias("origin"),
    )


_DISPOSITIONS = "CASE l_linenumber % 5 WHEN 0 THEN array('absent', 'absent') WHEN 1 THEN array('review') WHEN 2 THEN array('accepted', 'review') WHEN 3 THEN array('rejected', 'absent') ELSE array('absent', 'review') END"


@query(
    rf"""WITH c AS (SELECT l_orderkey, l_linenumber, {_DISPOSITIONS.replace('array(', 'list_value(')} AS cells, {_NAMES} AS name, l_returnflag = 'R' AS blocked, CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'candidate' END AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN len(list_filter(cells, lambda x: x <> 'absent')) = 0 THEN 'all_absent' WHEN len(list_filter(cells, lambda x: x <> 'review')) = 0 THEN 'all_in_review' WHEN list_contains(cells, 'accepted') THEN 'accepted' WHEN list_contains(cells, 'rejected') THEN 'some_rejected' ELSE 'mixed' END AS no_accept,
  CASE WHEN trim(name) = '' THEN 'no_name' WHEN regexp_matches(name, '[0-9]{{2,7}}\s*-\s*[0-9]{{2}}') THEN 'malformed_number' ELSE 'no_number' END AS no_number,
  CASE WHEN blocked THEN 'blocked' WHEN st IS NULL OR st <> 'accepted' THEN 'not_accepted' WHEN trim(name) = '' THEN 'empty' ELSE 'ok' END AS record,
  CASE WHEN l_linenumber = 1 THEN 'candidate_path' WHEN blocked OR l_linenumber > 5 THEN 'accepted' ELSE 'quality_gate' END AS gold_table,
  CASE WHEN l_linenumber > 3 AND regexp_matches(name, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') AND l_linenumber % 2 = 0 THEN 'TABLE_MISSING' WHEN NOT (l_linenumber > 3 AND regexp_matches(name, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]')) AND l_linenumber % 2 > 0 THEN 'UNEXPECTED_TABLE' ELSE 'OK' END AS detection,
  CASE WHEN regexp_matches(lower(name), '\b(?:twa|stel|ceiling|oel)\b') OR regexp_matches(lower(name), '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') THEN 'limits' ELSE 'unknown' END AS family FROM c"""
)
def disposition_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why rows, records and tables weren't accepted, and what a table is about."""
    c = _cells(spark, sf, cells=_DISPOSITIONS, name=_NAMES, blocked="l_returnflag = 'R'", st="CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linestatus = 'O' THEN 'accepted' ELSE 'candidate' END")
    n = F.col("l_linenumber")
    return c.select(
        *_IDS,
        quality.no_accept_reason(F.col("cells")).alias("no_accept"),
        quality.missing_number_reason(F.col("name")).alias("no_number"),
        quality.record_reason(F.col("st"), F.col("blocked"), F.col("name")).alias("record"),
        quality.gold_table_reason(F.when(n == 1, "data/candidates/x").otherwise("data/gold/x"), F.col("blocked"), [n > 5, F.lit(True)]).alias("gold_table"),
        quality.detection_gate(F.when(n > 3, "limits").otherwise("other"), F.col("name"), n % 2).alias("detection"),
        gold.classify_table(F.col("name")).alias("family"),
    )
