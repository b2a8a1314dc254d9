"""State over time as batch and as stream, readers and writers."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from foliant.sources import documents, records
from foliant.streaming import state


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture
def events(spark):
    data = [("a", at(0), 1.0, 1), ("a", at(10), 2.0, 2), ("a", at(4000), 3.0, 3), ("b", at(5), 4.0, 4)]
    return spark.createDataFrame(data, "k string, ts timestamp, v double, i int")


def test_sessions(events):
    assert sorted(rows(state.sessions(events, "k", "ts"), "k", "session")) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]
    assert sorted(rows(state.session_totals(events, "k", "ts", "v"), "k", "events", "total")) == [("a", 1, 3.0), ("a", 2, 3.0), ("b", 1, 4.0)]


def test_token_bucket(spark):
    data = [("a", at(0), i) for i in range(5)] + [("a", at(1), 9)]
    df = spark.createDataFrame(data, "k string, ts timestamp, i int")
    assert rows(state.token_bucket(df, "k", "ts", ["i"], rate=1.0, burst=3.0), "k", "allowed", "denied") == [("a", 4, 2)]


def test_cache(spark):
    df = spark.createDataFrame([("a", at(s)) for s in (0, 5, 12, 13, 30)], "k string, ts timestamp")
    assert rows(state.cache_hits(df, "k", "ts", 10), "requests", "hits") == [(5, 2)]
    assert rows(state.keep_recent(df.groupBy("k").agg(F.max("ts").alias("u")), "k", "u", 1), "k") == [("a",)]


def run_stream(spark, source, make, tmp_path, mode="append"):
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    name = "out_" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    # Queries with processing-time timers never run out of batches, so wait for rows, not for an end.
    for _ in range(120):
        if spark.table(name).count() or q.exception():
            break
        time.sleep(0.5)
    q.stop()
    return spark.table(name)


def test_token_bucket_stream_agrees_with_the_fold(spark, tmp_path):
    data = [(f"k{i % 3}", at(i // 4), i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, ts timestamp, i int")
    got = run_stream(spark, df.coalesce(1), lambda s: state.token_bucket_stream(s, "k", "ts", 1.0, 3.0), tmp_path, "update")
    want = state.token_bucket(df, "k", "ts", ["i"], 1.0, 3.0)
    assert sorted(rows(got, "k", "allowed", "denied")) == sorted(rows(want, "k", "allowed", "denied"))


def test_session_slots_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, None), (1, 2, "y"), (2, 0, None)], "s int, t int, name string")
    got = run_stream(spark, df.coalesce(1), lambda s: state.session_slots_stream(s, "s", "t", ["name"]), tmp_path)
    assert sorted(rows(got, "s", "t", "carried_name"), key=str) == [(1, 0, "x"), (1, 1, "x"), (1, 2, "y"), (2, 0, None)]


def test_windows_stream(spark, tmp_path, events):
    got = run_stream(spark, events.coalesce(1), lambda s: state.windowed(s, "ts", "k", "v"), tmp_path, "complete")
    assert sorted(rows(got, "k", "events", "total")) == [("a", 1, 3.0), ("a", 2, 3.0), ("b", 1, 4.0)]


def test_distinct_stream(spark, tmp_path, events):
    got = run_stream(spark, events.coalesce(1), lambda s: state.distinct_within(s, ["k"], "ts"), tmp_path)
    assert sorted(r[0] for r in rows(got, "k")) == ["a", "b"]


CLASSIC = {
    "text": "CAS 67-64-1 Acetone",
    "pages": [
        {
            "pageNumber": 3,
            "tables": [
                {
                    "headerRows": [{"cells": [{"layout": {"confidence": 0.9, "textAnchor": {"textSegments": [{"endIndex": "3"}]}}}]}],
                    "bodyRows": [{"cells": [{"layout": {"confidence": 0.8, "textAnchor": {"textSegments": [{"startIndex": "4", "endIndex": "11"}]}}}, {"layout": {"textAnchor": {"textSegments": [{"startIndex": "12", "endIndex": "19"}]}}}]}],
                }
            ],
        }
    ],
}
LAYOUT = {
    "documentLayout": {
        "blocks": [
            {"textBlock": {"text": "Title", "type": "heading-1", "blocks": [{"textBlock": {"text": "Body", "type": "paragraph"}}]}, "pageSpan": {"pageStart": 2, "pageEnd": 2}},
            {"tableBlock": {"bodyRows": [{"cells": [{"blocks": [{"textBlock": {"text": "x"}}]}, {"blocks": [{"textBlock": {"text": "y"}}, {"textBlock": {"text": "z"}}]}]}]}, "pageSpan": {"pageStart": 2}},
        ]
    }
}


def test_extractions(spark):
    df = spark.createDataFrame([("c", json.dumps(CLASSIC)), ("l", json.dumps(LAYOUT)), ("u", "{}")], "id string, body string")
    assert sorted(rows(df.select("id", documents.extraction_kind("body").alias("k")), "id", "k")) == [("c", "classic"), ("l", "layout"), ("u", "unknown")]
    cells = sorted(rows(documents.adapt_extractions(df, "id", "body"), "id", "page_number", "row_index", "column_index", "text"))
    assert cells == [("c", 3, 0, 0, "CAS"), ("c", 3, 1, 0, "67-64-1"), ("c", 3, 1, 1, "Acetone"), ("l", 2, 0, 0, "x"), ("l", 2, 0, 1, "y z")]
    blocks = sorted(rows(documents.layout_blocks(df, "id", "body"), "path", "page_number", "kind", "text"))
    assert blocks == [("0000", 2, "heading-1", "Title"), ("0000.0000", 2, "paragraph", "Body")]


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><p>One <b>two</b><br>three</p><script>x()</script><ul><li>a</li><li>b &amp; c</li></ul></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "plain")], "page_id long, html string")
    assert sorted(rows(documents.html_blocks(df), "page_id", "block", "tag", "text")) == [(1, 0, "title", "T"), (1, 1, "p", "One two three"), (1, 2, "li", "a"), (1, 3, "li", "b & c"), (3, 0, "body", "plain")]


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    got = documents.files(spark, str(tmp_path), "*.pdf").select("length", "sha256").first()
    assert got["length"] == 3 and got["sha256"].startswith("ba7816bf")
    pages = spark.createDataFrame([(i, "x" * i * 10) for i in range(1, 6)], "page int, text string")
    assert sorted(rows(documents.page_range(pages, "page", "text", 2, 4), "page", "has_digital_text")) == [(2, False), (3, True), (4, True)]
    assert documents.page_range(pages, "page", "text", limit=2).count() == 2


def test_records(spark, tmp_path):
    path = tmp_path / "chunks.jsonl"
    path.write_text('{"chunk_id":"a","content":"x","page_number":1}\n{"chunk_id":"b","content":"y","page_number":5}\n')
    held = records.read_lines(spark, str(path))
    assert sorted(rows(held, "chunk_id")) == [("a",), ("b",)]
    ok, bad = records.split_by_gate(held, F.when(F.col("page_number") > 3, "late").otherwise("ok"))
    assert rows(ok, "chunk_id") == [("a",)] and rows(bad, "reject_reason") == [("late",)]
    assert rows(records.promote(held, F.col("chunk_id") == "a"), "chunk_id", "validation_status") == [("b", "accepted")]
    new = spark.createDataFrame([("c", 5), ("d", 9)], "chunk_id string, page_number int")
    assert sorted(rows(records.overwrite_pages(held.select("chunk_id", "page_number"), new, "page_number", 4, 6), "chunk_id")) == [("a",), ("c",)]
    bad_line = tmp_path / "qa.jsonl"
    bad_line.write_text('{"id":"1","question":"q"}\n{broken\n')
    with pytest.raises(Exception):
        records.read_questions(spark, str(bad_line)).collect()
    good = tmp_path / "good.jsonl"
    good.write_text('{"id":"1","question":"q"}\n')
    assert records.read_questions(spark, str(good), 1).count() == 1
    with pytest.raises(ValueError):
        records.read_questions(spark, str(good), 2)


def test_snapshots(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    manifest = records.snapshot(df, str(tmp_path / "s"), ["p"])
    assert manifest.agg(F.sum("rows")).first()[0] == 10
    with pytest.raises(Exception):
        records.snapshot(df, str(tmp_path / "s"))
    for n in (3, 5):
        records.swap_in(spark.range(n), str(tmp_path / "t"))
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    records.write_lines(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_blocks_of_any_depth(spark):
    """Nested blocks come whole, however deep they lie."""
    import json

    from foliant.sources import documents

    def nest(n):
        block = {"textBlock": {"text": f"level {n}", "type": "paragraph"}}
        if n < 20:
            block["textBlock"]["blocks"] = [nest(n + 1)]
        return block

    body = json.dumps({"documentLayout": {"blocks": [{**nest(0), "pageSpan": {"pageStart": 3, "pageEnd": 3}}]}})
    df = spark.createDataFrame([("a", body)], "id string, body string")
    got = sorted((r["path"], r["text"], r["page_number"]) for r in documents.layout_blocks(df, "id", "body").collect())
    assert [t for _, t, _ in got] == [f"level {n}" for n in range(21)] and {p for _, _, p in got} == {3}
    assert got[20][0] == ".".join(["0000"] * 21)
