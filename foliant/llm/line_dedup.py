"""Removal of boilerplate lines by the number of distinct sites that carry them.

Only DataFrame functions are used.  For each line hash a HyperLogLog sketch of its
sites is built map-side and merged by aggregation.  Lines whose estimate lies within
the sketch's error of the threshold get exact distinct counts; the others are decided
by the estimate.  A boilerplate line goes from every document, however long it is and
whatever share of the text; copies of documents are for document-level dedup.

Lines meet the table of line hashes by a broadcast while it is small.  Beyond that, only the
hashes of very frequent lines are broadcast, of which there can be few, and the others are
joined by a shuffle, in which no key has many lines.

Defined cases: a null text stays null and has no lines; blank lines are never boilerplate; a
null site is no site; repeated rows count as rows of their own and are treated alike; a text
of boilerplate only becomes empty; other columns pass through unchanged, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, by_position, cut, join_counted, place_of, texts

#: A line on at least this many sites is boilerplate.
MIN_SITES = 8
#: Precision of the sketches, and the deviations that "near" spans.
LOG2_REGISTERS, DEVIATIONS = 12, 4


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _counts(line: Column) -> Column:
    return F.length(F.trim(line)) >= 1


def _lines(numbered: DataFrame) -> DataFrame:
    """row, site, key of every line that can be boilerplate."""
    each = numbered.select("row", "site", F.explode(F.split("text", "\n", -1)).alias("line"))
    return each.filter(_counts(F.col("line"))).select("row", "site", _key(F.col("line")).alias("key"))


def _having(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines whose key is in `keys` (key, n: distinct keys and their lines)."""
    if keys.count() <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys.select("key")), "key")
    return join_counted(lines, keys, "key")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """key, n: lines on at least min_sites distinct sites, and how often they occur."""
    sketches = lines.groupBy("key").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS)).alias("sketch"))
    estimated = cut(sketches.filter(F.col("n") >= min_sites).select("key", "n", F.hll_sketch_estimate("sketch").alias("sites")))
    margin = max(1, math.ceil(DEVIATIONS * 1.04 / math.sqrt(2**LOG2_REGISTERS) * min_sites))
    sure = estimated.filter(F.col("sites") > min_sites + margin).select("key", "n")
    near = estimated.filter(F.col("sites").between(min_sites - margin, min_sites + margin)).select("key", "n")
    exact = _having(lines, near).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("site").alias("sites"))
    return cut(sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("key", "n")))


def _cleaned(docs: DataFrame, site: str, min_sites: int) -> tuple[DataFrame, list[str]]:
    """Columns c0, c1, ... by place, and cleaned, n_lines, n_removed; and the columns' own names."""
    plain, names = by_position(docs)
    text, doc = F.col(f"c{place_of(names, 'text')}").cast("string"), F.col(f"c{place_of(names, 'doc_id')}")
    # A row's name: its own values.  Rows that are equal in all that matters here are treated alike.
    table = plain.select(*plain.columns, F.xxhash64(doc, text).alias("row"), F.col(f"c{place_of(names, site)}").cast("string").alias("site"), text.alias("text"))
    lines = _lines(table)
    hits = _having(lines, boilerplate(lines, min_sites)).groupBy("row").agg(F.collect_set("key").alias("bad"))
    joined = table.drop("site").join(hits, "row", "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x: ~(_counts(x) & F.array_contains("bad", _key(x))))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    joined = joined.select(*plain.columns, "text", n_lines.alias("n_lines"), F.when(F.col("bad").isNotNull(), kept).alias("kept"))
    some = F.col("kept").isNotNull()
    return joined.select(
        *plain.columns,
        F.when(some, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("cleaned"),
        "n_lines",
        F.when(some, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"),
    ), names


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, n_chars: str | None = None, report: str | None = None) -> DataFrame:
    """`docs` with boilerplate lines taken out of text.

    `n_chars` names a column that follows the length of texts that lose lines; `report` names
    a new column struct(n_lines, n_removed), which may not be among the columns already.
    """
    if report in docs.columns:
        raise ValueError(f"{report} is a column already")
    cleaned, names = _cleaned(docs, site, min_sites)
    out = [F.col(f"c{i}") for i in range(len(names))]
    out[place_of(names, "text")] = F.col("cleaned")
    if n_chars:
        at = place_of(names, n_chars)
        out[at] = F.when(F.col("n_removed") > 0, F.length("cleaned").cast(cleaned.schema[at].dataType)).otherwise(out[at])
    if report:
        out, names = [*out, F.struct("n_lines", "n_removed")], [*names, report]
    return cleaned.select(*[c.alias(f"o{i}") for i, c in enumerate(out)]).toDF(*names)


#: The result of line_report for documents, by exact counts.
SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents
), bad AS (
  SELECT trim(line, ' ') AS k FROM l WHERE length(trim(line, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), j AS (
  SELECT l.doc_id, l.i, l.line, bad.k IS NOT NULL AS gone FROM l LEFT JOIN bad ON trim(l.line, ' ') = bad.k
), d AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM j GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n, 0) AS n_lines, coalesce(g, 0) AS n_removed, CASE WHEN g > 0 THEN t ELSE text END AS text
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id
"""


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the cleaned text."""
    cleaned, _ = _cleaned(texts(docs, "source"), "source", MIN_SITES)
    return cleaned.select(F.col("c0").alias("doc_id"), "n_lines", "n_removed", F.col("cleaned").alias("text"))
