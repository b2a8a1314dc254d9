"""Column functions on literal fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry, identity, numeric, text


@pytest.fixture
def values(spark):
    """Apply an expression to each of some values (tuples: columns a, b, c)."""

    def run(make, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = "abcd"[: len(rows[0])]
        kinds = [next((k for k, t in (("boolean", bool), ("long", int), ("double", float), ("string", str), ("array<double>", list)) if any(isinstance(r[i], t) for r in rows)), "string") for i in range(len(names))]
        schema = "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        return [r[1] for r in sorted(df.select("i", make(*[F.col(n) for n in names]).alias("x")).collect())]

    return run


def test_fragments_of_any_length(values):
    """A run of very many pieces is one match and takes no stack; a run ends before a longer word."""
    assert values(text.confirmed_fragments, "ab c " * 100_000, "ab c de fgh", "ab c def", "a b cde fg h ij") == [0, 1, 0, 1]


def test_persian_text(values):
    got = values(text.normalize_persian_text, "  كتاب‌علي ۱۲۳  ", "خانۀ  ٤٥", None)
    assert got == ["کتاب علی 123", "خانه 45", None]
    assert values(text.contains_persian, "abc", "abc ف", "") == [False, True, False]
    assert values(text.latin_digits, "۰۹ ٠٩ 09") == ["09 09 09"]


def test_queries(values):
    assert values(text.normalize_query, "what is  twe of toluene؟", "STELL ۵") == ["what is TWA of toluene?", "STEL 5"]
    assert values(text.strip_limit_prefix, "TWA: toluene", "stel of x", "toluene") == ["toluene", "of x", "toluene"]
    assert values(lambda c: text.expand_abbreviations(c, {"MW": "molecular weight"}), "mw of x") == ["molecular weight of x"]


def test_tokens(values):
    assert values(text.lexical_tokens, "Acetone 67-64-1 a the, the") == [["67-64-1", "acetone", "the", "the"]]
    assert values(text.token_set, "Acetone 67-64-1 a the, the") == [["acetone", "67", "64", "the"]]
    assert values(text.lexical_tokens, "سلام! دنیا") == [["سلام", "دنیا"]]


def test_ocr(values):
    assert values(text.confirmed_fragments, "a b c d e", "normal words here", "ab cd ef") == [1, 0, 1]
    assert values(text.join_fragments, "t o l u ene is here", "a b") == ["tolu ene is here", "ab"]
    assert values(text.rebuild_block, "first line\nruns on.\nNext") == ["first line runs on.\nNext"]
    assert values(text.spaced_marks, "a ,b ; c") == ["a, b; c"]
    assert values(text.is_fragment, "short", "x" * 100) == [True, False]
    assert values(text.incomplete_sentence, "This is a whole sentence.", "and this one stops at") == [False, True]
    assert values(lambda c: text.looks_like_table_header(c, ["TWA", "STEL", "CAS"]), "CAS | TWA | STEL", "only TWA") == [True, False]
    assert values(text.looks_like_table_row, "toluene 108-88-3 50 ppm", "prose only") == [True, False]


def test_edits(spark):
    df = spark.createDataFrame([("abcdef", [(1, 3, "X"), (4, 5, "")])], "t string, e array<struct<start:int,end:int,new:string>>")
    assert df.select(text.apply_edits(F.col("t"), F.col("e"))).first()[0] == "aXdf"


def test_changes_and_repairs(values):
    assert [tuple(x) for x in values(text.changed_middle, ("abcde", "abXYde"), ("same", "same"), ("aa", "aaa"))] == [(2, "c", "XY"), (4, "", ""), (2, "", "a")]
    assert values(text.validate_repair, ("le ad 5 mg", "lead 5 mg", 0.95), ("le ad 5 mg", "lead 6 mg", 0.95), ("ک ت اب", "کتاب", 0.8), ("a", "a", 0.5)) == ["REJECT", "REJECT", "REVIEW", "REJECT"]


def test_coverage(values):
    assert values(text.token_coverage, ("alpha beta gamma", "alpha delta"), ("x", "")) == [0.5, 0.0]
    assert values(text.text_overlaps, ("one two three", "two three"), ("aa bb", "cc dd")) == [True, False]
    assert values(text.jaccard, ([1.0, 2.0], [2.0, 3.0])) == [1 / 3]


def test_append_uncovered(spark):
    df = spark.createDataFrame([(["Alpha beta", "beta", None, " ", "gamma"],)], "p array<string>")
    assert df.select(text.append_uncovered(F.col("p"))).first()[0] == "Alpha beta\ngamma"


def test_numeric_cells(values):
    got = [(r["normalized"], r["status"], r["unit"]) for r in values(numeric.parse_numeric_cell, "3/0", "0009/0", "0/0009", "25 ppm", "C 25 ppm", "-", "", "۲۵", "mg/m³", "3 mg/m 0.5", None, "text")]
    assert got[:6] == [("0.3", "REVIEW_REQUIRED", None), ("0.0009", "REVIEW_REQUIRED", None), ("0.0009", "REVIEW_REQUIRED", None), ("25", "VALIDATED", "ppm"), ("25", "VALIDATED", "ppm"), (None, "ABSENT", None)]
    assert [s for _, s, _ in got[6:]] == ["ABSENT", "VALIDATED", "NOT_NUMERIC", "VALIDATED", "ABSENT", "NOT_NUMERIC"]


def test_three_readings_of_a_slash(values):
    assert values(numeric.slash_point, "3/0", "x 12", "none") == [3.0, 12.0, None]
    assert values(numeric.slash_quotient, "3/0", "6/3 and 4", "1.5/0.5") == [[], [2.0, 4.0], [3.0]]
    assert values(lambda a, b: numeric.slash_decimal(a, b), ("3", "0"), ("0", "0009"), ("12", "5"), ("1234", "56")) == ["0.3", "0.0009", "12.5", None]


def test_other_numbers(values):
    assert values(numeric.ceiling_from_cell, "C 25 ppm", "25 ppm") == ["25", None]
    assert values(numeric.molecular_weight, "85.10", "10/85", "92", "none") == ["85.10", "85.10", "92", None]
    assert values(numeric.mixed_row_numbers, "12 12", "12 13", "") == [False, True, False]
    assert values(numeric.unit_only, "mg/m³", "mg / m 3", "5 ppm") == [True, True, False]
    assert values(numeric.value_unprovable, ("5", "is 5 ppm"), ("6", "is 5 ppm")) == [False, True]
    assert [tuple(r) for r in values(numeric.parse_limits, "TWA 5 ppm STEL: 10", "C 2 mg/m3")] == [(5.0, 10.0, None, "ppm"), (None, None, 2.0, "mg/m3")]
    assert values(numeric.same_value, (1.0, 1.0), (1.0, None), (1.0, 1.1)) == [True, False, False]


def test_exposure(values):
    got = values(numeric.daily_exposure, ([2.0, 4.0], [4.0, 4.0]), ([1.0], [1.0, 2.0]), ([1.0], [0.0]))
    assert got[0]["value"] == pytest.approx(math.sqrt(10)) and got[0]["valid"]
    assert [g["issue"] for g in got[1:]] == ["length_mismatch", "non_positive_time"] and math.isnan(got[1]["value"])


def test_confidence(values):
    assert [round(r["score"], 6) for r in values(numeric.composite_confidence, (0.5, 0.6, 0.8), (None, 0.6, 0.8))] == [0.61, 0.67]
    assert values(numeric.weakest, (0.5, None), (None, 0.4), (0.2, 0.1)) == [0.5, 0.4, 0.1]
    assert values(numeric.weakest_or_unknown, ("0.5", None), (None, None)) == ["0.5", "unknown"]
    assert values(numeric.review_priority, 0.9, 0.7, 0.1) == ["auto", "review", "high"]


def test_cas(values):
    assert values(identity.normalize_cas, "acetone [67-64-1] x", "67 - 64 - 1", "none", None) == ["67-64-1", "67-64-1", None, None]
    assert values(identity.is_valid_cas, "67-64-1", "67-64-2", "7732-18-5", "x", None) == [True, False, True, False, False]
    assert values(identity.extract_cas, ("67-64-1, 67-64-1", "108-88-3")) == [["67-64-1", "108-88-3"]]
    assert values(identity.cas_issues, "67-64-1", "67") == [[], ["cas_format"]]


def test_names(values):
    assert values(identity.is_generic, "Acid", "acetic acid", "", "salts and compounds") == [True, False, True, True]
    assert values(identity.same_token_set, ("acid, Acetic", "acetic acid"), ("acid", "Acid"), ("a b", "a c")) == [True, False, False]
    got = values(identity.identity_names, ("Acetone 67-64-1", "استون"), ("acid", "Toluene diisocyanate"))
    assert (got[0]["cas"], got[0]["latin"], got[0]["persian"]) == ("67-64-1", "Acetone", "استون")
    assert got[1]["latin"] == "Toluene diisocyanate"
    assert values(identity.search_variants, "acid, Acetic")[0][:2] == ["acid, Acetic", "acid, acetic"]
    assert "Acetic acid" in values(identity.search_variants, "acid, Acetic")[0]


def test_entities(values):
    got = values(identity.entities, "Acetone 67-64-1 Toluene [108-88-3]\nacid", "plain name")
    assert [(e["cas"], e["review"]) for e in got[0]] == [("67-64-1", False), ("108-88-3", False), (None, True)]
    assert [e["name"] for e in got[0]] == ["Acetone", "Toluene", "acid"]
    assert got[1][0]["review"] is True


def test_aliases(spark):
    df = spark.createDataFrame([("Acetone", "استون", ["acetone oil", "Acid", "Acetone", "پروپانون"])], "e string, p string, x array<string>")
    got = df.select(identity.identity_aliases(F.col("e"), F.col("p"), F.col("x"))).first()[0]
    assert got["en"] == ["acetone oil"] and got["fa"] == ["استون", "پروپانون"]


def test_boxes(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 10.0, 10.0)), ((0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 0.0, 1.0))], "a struct<x:double,y:double,width:double,height:double>, b struct<x:double,y:double,width:double,height:double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(geometry.overlap_ratio(a, b), geometry.iou(a, b), geometry.geometry_gate(b, F.lit(0.9)), geometry.geometry_gate(a, F.lit(None).cast("double"))).collect()
    assert tuple(got[0]) == (0.25, 25 / 175, "ACCEPT", "LOW_CONFIDENCE")
    assert tuple(got[1]) == (0.0, 0.0, "MISSING_BBOX", "LOW_CONFIDENCE")


def test_columns_and_keys(values, spark):
    assert values(lambda x, w: geometry.column_of(x, w), (5.0, 100.0), (30.0, 100.0), (95.0, 100.0)) == [0, 2, 6]
    assert values(lambda x, c: geometry.nearest(x, c), (5.0, [1.0, 4.0, 9.0]), (6.5, [4.0, 9.0])) == [1, 0]
    assert values(geometry.cell_page, "doc:p46:t1", "page_7_x", "none") == [46, 7, None]
    assert values(geometry.printed_or_page, ("5", None), ("5", "7")) == ["5", "7"]
    js = spark.createDataFrame([('{"n": {"value": " a "}}', '{"n": "b"}'), ("{}", '{"n": "b"}'), ('{"n": ""}', None)], "x string, y string")
    assert [r[0] for r in js.select(geometry.field_text("n", F.col("x"), F.col("y"))).collect()] == ["a", "b", None]


def test_ordered_rules(values):
    rules = lambda c: identity.ordered_rules([(c > 5, "big"), (c > 1, "some")], "none")
    assert values(rules, 7, 3, 0, None) == ["big", "some", "none", "none"]


def test_triage(values):
    got = values(lambda c: numeric.triage_page(c, ["twa", "stel", "cas", "ppm", "limit"]), "twa stel cas ppm in a table", "", "E = m c", "long text " * 300)
    assert [g["kind"] for g in got] == ["table", "scanned", "scanned", "text"]
