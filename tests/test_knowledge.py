"""Modes, evaluation sets, loading of knowledge, plug-ins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import evaluation, knowledge, modes
from foliant.plans import protocols


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture
def pools(spark):
    v = spark.createDataFrame([("q", i, 1.0 - i / 10, i) for i in range(1, 7)], "query string, document int, score double, rank int")
    x = spark.createDataFrame([("q", 6, 0.9, 1), ("q", 9, 0.8, 2), ("p", 2, 0.7, 1)], "query string, document int, score double, rank int")
    return v, x


def test_modes(spark, pools):
    v, x = pools
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(1, 10)], "document int, text string")
    asked = spark.createDataFrame([("q", "word9 common"), ("p", "word2")], "query string, question string")
    got = {}
    for mode in modes.MODES:
        out = modes.retrieve(mode, v, x, page_match=F.col("document") % 2 == 0, texts=(docs, asked), tiers=[F.col("document") == 9])
        assert out.columns == ["query", "document", "score", "rank"]
        got[mode] = [d for d, in rows(out.filter("query = 'q'").orderBy("rank"), "document")]
        assert len(got[mode]) <= modes.FINAL
    assert got["VECTOR_ONLY"] == [1, 2, 3, 4, 5] and got["LEXICAL_ONLY"] == [6, 9] and got["VECTOR_METADATA"] == [2, 4, 6]
    assert got["RRF"][0] == 6 and got["EVIDENCE_CANDIDATES"][0] == 9 and got["HYBRID_RERANK"][0] == 9
    with pytest.raises(ValueError):
        modes.retrieve("OTHER", v, x)
    back = modes.with_fallback(v, x)
    assert {q for q, in rows(back, "query")} == {"p", "q"} and back.filter("query = 'q'").count() == 6
    relevant = spark.createDataFrame([("q", [6])], "query string, relevant array<int>")
    report = {m: r for m, r in rows(modes.compare_modes({"v": v, "x": x}, relevant), "mode", "mrr")}
    assert report["x"] == 1.0 and report["v"] == pytest.approx(1 / 6, abs=1e-5)
    assert modes.limited_pool(v, F.col("document") > 2, 2, [F.asc("rank")]).count() == 2


def test_cases(spark):
    facts = spark.createDataFrame([(1, "Acetone", "5"), (2, "Toluene", None)], "id int, name string, twa string")
    s = evaluation.structured_cases(facts, "id", "name", {"twa": "TWA of %s?"})
    assert rows(s, "query_id", "question", "relevant") == [("structured:1:twa", "TWA of Acetone?", ["1"])]
    chunks = spark.createDataFrame([("c1", "Noise", "text"), ("c2", "", "one two three"), ("c3", None, " ")], "id string, title string, text string")
    m = evaluation.semantic_cases(chunks, "id", "title", "text")
    assert rows(m, "question") == [("Explain Noise.",), ("Explain one two three.",)]
    both = evaluation.hybrid_cases(s.withColumn("k", F.lit(1)), m.withColumn("k", F.lit(1)), "k")
    assert both.count() == 2 and rows(both, "relevant")[0] == (["1", "c1"],)
    bad = spark.createDataFrame([("a", "q", ["1"]), ("b", "q", ["7"]), ("c", "", []), ("d", "r", None)], "query_id string, question string, relevant array<string>")
    got = dict(rows(evaluation.case_issues(bad, facts, "id"), "query_id", "issues"))
    assert got == {"a": "repeated_question", "b": "unknown_id,repeated_question", "c": "no_question,nothing_relevant", "d": "nothing_relevant"}


def test_against_gold(spark):
    gold = spark.createDataFrame([(1, "x", 5.0, None), (1, "y", 6.0, 7.0), (2, "z", 1.0, None)], "page int, cas string, twa double, stel double")
    got = spark.createDataFrame([(1, "x", 5.0, 9.0), (1, "y", 6.5, 7.0)], "page int, cas string, twa double, stel double")
    out = {r["field"]: r for r in evaluation.against_gold(got, gold, ["page", "cas"], ["twa", "stel"]).collect()}
    assert (out["twa"]["compared"], out["twa"]["correct"], out["twa"]["missing"]) == (3, 1, 1) and out["stel"]["accuracy"] == 1.0
    a = spark.createDataFrame([(1, "a", ["n1", "n2"]), (2, "b", ["n1"])], "page int, id string, cas array<string>")
    b = spark.createDataFrame([(1, "c", ["n2", "n1", "n1"]), (1, "d", ["n9"])], "page int, id string, cas array<string>")
    assert rows(evaluation.shared_numbers(a, b, "page", "cas"), "left_id", "right_id", "shared") == [("a", "c", 2)]
    t = spark.createDataFrame([(False, True, True, False, False), (True, False, False, False, False), (False, True, True, True, True)], "a boolean, g boolean, s boolean, r boolean, k boolean")
    assert [r[0] for r in t.select(evaluation.failure_cause(*[F.col(c) for c in "agsrk"])).collect()] == ["candidate_generation", "none", "answer_generation"]
    m = spark.createDataFrame([(1, "N", "twa", 5.0, 1, "n", "twa", 5.0), (1, "N", "twa", 5.0, 1, "n", "twa", None), (1, "N", "twa", 5.0, 2, "n", "twa", 5.0)], "p int, n string, f string, v double, q int, o string, g string, w double")
    assert [r[0] for r in m.select(evaluation.record_matches(*[F.col(c) for c in "pqnofgvw"])).collect()] == [True, True, False]


def test_summaries(spark):
    c = spark.createDataFrame([("a", 1.0, "none", ["s"], "q1"), ("a", 0.0, "ranking", ["s", "f"], "q2"), ("b", 1.0, "none", ["f"], "q2")], "kind string, hit double, cause string, agents array<string>, q string")
    means, causes = evaluation.summarize(c, "kind", ["hit"], "cause")
    assert sorted(rows(means, "kind", "cases", "hit"), key=str) == [("a", 2, 0.5), ("b", 1, 1.0), (None, 3, 0.666667)]
    assert sorted(rows(causes, "cause", "cases")) == [("none", 2), ("ranking", 1)]
    s = rows(evaluation.statistics(c, "kind", "agents", "q"), "dimension", "value", "cases")
    assert ("agent", "f", 2) in s and ("unique_questions", None, 2) in s
    f = spark.createDataFrame([("sqrt(a)",), ("x+1",), (" ",), (None,)], "e string")
    assert [r["support"] for r in evaluation.formula_inventory(f, "e", ["sqrt"]).collect()] == ["executable", "registry_only", "unsupported", "unsupported"]


def test_sync(spark):
    target = spark.createDataFrame([("a", "x", [1.0]), ("b", "y", [2.0])], "k string, content string, embedding array<double>")
    source = spark.createDataFrame([("a", "x"), ("b", "changed"), ("c", "new"), ("d", "")], "k string, content string")
    after, stats = knowledge.sync(target, source, "k", "content", ["embedding"], F.when(F.col("content") == "", "empty").otherwise("ok"))
    assert tuple(stats.first()) == (1, 1, 1, 1)
    assert sorted(rows(after, "k", "embedding")) == [("a", [1.0]), ("b", None), ("c", None)]
    chunks = spark.createDataFrame([("t", 1, "Acetone", [1.0]), ("t", 2, "whole 5", [2.0]), ("u", 1, "alone", [3.0])], "t string, r int, content string, embedding array<double>")
    cells = spark.createDataFrame([("t", 1, 1, "5 ppm"), ("t", 1, 0, "acetone"), ("t", 2, 0, "5")], "t string, r int, c int, text string")
    got = sorted(rows(knowledge.enrich_rows(chunks, cells, "t", "r", "c", "text"), "t", "r", "content", "embedding"))
    assert got == [("t", 1, "Acetone\n5 ppm", None), ("t", 2, "whole 5", [2.0]), ("u", 1, "alone", [3.0])]
    pending = spark.createDataFrame([(i, "accepted" if i % 2 else "review", f"t{i}", None) for i in range(40)], "id int, validation_status string, content string, embedding array<double>")
    out = knowledge.embed_pending(pending, "id", "content", "embedding", lambda texts: [[float(len(texts)), float(len(t))] for t in texts])
    assert out.count() == 20 and max(e[0] for _, e in rows(out, "id", "embedding")) <= knowledge.BATCH
    assert tuple(knowledge.corpus_counts(pending).first()) == (20, 0)
    assert rows(knowledge.row_chunk_ids(spark.createDataFrame([("t9", 7)], "t string, i int"), "t", "i"), "chunk_id") == [("row_t9_007",)]


def test_plugins(spark, pools):
    v, _ = pools
    assert protocols.HeadReranker().rerank(None, v, 2).count() == 2
    docs = spark.createDataFrame([(i, "alpha" if i == 6 else "beta") for i in range(1, 7)], "document int, text string")
    asked = spark.createDataFrame([("q", "alpha")], "query string, question string")
    assert rows(protocols.LexicalReranker(docs).rerank(asked, v, 1), "document") == [(6,)]
    registry = protocols.SchemaRegistry()
    registry.register("limits", T.StructType([T.StructField("twa", T.StringType())]), {"twa_missing": F.col("twa").isNull()}, {"TWA ppm": "twa"})
    assert registry.field_of("limits", " twa  PPM ") == "twa" and registry.field_of("limits", "x") is None
    df = spark.createDataFrame([("1",), (None,)], "twa string")
    assert [r[0] for r in df.select(registry.issues("limits")).collect()] == [[], ["twa_missing"]]
