"""Buffers, words, shingles, dealing: properties over arbitrary texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import common, deal
from foliant.llm.frequent import frequent_prints
from foliant.llm.quality import measure

from .test_scans import brute_quality

texts = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab \n\t\x0b\x1c\x85é😀#A"), max_size=60)), min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words(found):
    data, bounds = common.utf8(pa.array(found, pa.string()))
    words = common.Words(data, bounds)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e, d in zip(words.start, words.end, words.doc) if d == i] for i in range(len(found))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in found]
    same = {}
    for s, e, h in zip(words.start, words.end, words.hash):
        assert same.setdefault(raw[s:e], h) == h
    assert len(set(same.values())) == len(same)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_shingles(found):
    words = common.Words(*common.utf8(pa.array(found, pa.string())), lower=True)
    doc, h = common.shingles(words)
    names: dict = {}
    for i, t in enumerate(found):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        mine = h[doc == i]
        assert len(mine) == len(want) == len(set(mine.tolist()))
        names[frozenset(want)] = names.get(frozenset(want), frozenset(mine.tolist()))
        assert names[frozenset(want)] == frozenset(mine.tolist())


@settings(max_examples=150, deadline=None)
@given(texts)
def test_quality_of_any_text(found):
    got = measure(*common.utf8(pa.array(found, pa.string())), 10, 20, 100)
    for i, t in enumerate(found):
        mine = tuple(got[k][i].item() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat"))
        assert mine == brute_quality(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 2**63 - 1)), max_size=40))
def test_dealing_loses_nothing(records):
    fragment = np.array([f for f, _ in records], dtype=np.int64)
    value = np.array([v for _, v in records], dtype="<u8")
    numbers, blobs = deal.deal(fragment, [value, value.astype("<u4")])
    got = []
    for n, b in zip(numbers, blobs):
        a, c = deal.undeal([b], ["<u8", "<u4"])
        assert (a.astype("<u4") == c).all()
        got += [(n, x) for x in a.tolist()]
    assert sorted(got) == sorted(records)


def test_slices_cut_between_documents():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "b" * 100, "c", "d"])], ["uid", "text"])
    parts = list(common.slices(iter([batch]), 1, 12))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2], [3, 4]]


def test_frequent_prints(spark):
    """Counts over all rows, whatever task they lie in; the table is cut at a level."""
    rng = np.random.default_rng(3)
    values = np.repeat(rng.integers(0, 2**63, 300), rng.integers(1, 60, 300))
    rng.shuffle(values)
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)

    def hashes(batches):
        for b in batches:
            yield np.asarray(b.column(0)).astype(np.uint64)

    prints, levels = frequent_prints(df, hashes, 8)
    kinds, n = np.unique((values >> 32).astype(np.uint32), return_counts=True)
    assert prints.tolist() == kinds[n >= 8].tolist()
    assert levels.tolist() == np.log2(n[n >= 8]).astype(int).tolist()
    few, some = frequent_prints(df, hashes, 8, most=int((n >= 32).sum()))
    assert few.tolist() == kinds[n >= 32].tolist() and set(some.tolist()) == {5}


def test_packed_tables_leave_few_tasks(spark, monkeypatch):
    """Narrow tables come back in as many partitions as their rows need, with all rows, whatever unions added up."""
    wide = spark.range(0, 90, 1, 30).union(spark.range(90, 100, 1, 30))
    held = common.packed(wide)
    assert held.rdd.getNumPartitions() == 1 and sorted(r[0] for r in held.collect()) == list(range(100))
    assert common.packed(wide.filter("id < 0")).count() == 0
    monkeypatch.setattr(common, "PACKED_ROWS", 30)
    held = common.packed(wide)
    assert held.rdd.getNumPartitions() == 4 and sorted(r[0] for r in held.collect()) == list(range(100))
    assert common.packed(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 1


def test_join_reads_its_small_tables_in_few_tasks(spark, monkeypatch):
    """Each task of a shuffle leaves files: pairs, links and labels of a small join take one task, not one for each partition."""
    from foliant.llm import ngram_join

    tasks = []
    packed = ngram_join.packed
    monkeypatch.setattr(ngram_join, "packed", lambda df: [held := packed(df), tasks.append(held.rdd.getNumPartitions())][0])
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[: 60 - i % 3])) for i in range(40)] + [(99, "all alone here")], "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: 0 for i in range(40)} | {99: 99}
    assert len(tasks) > 5 and set(tasks) == {1}
