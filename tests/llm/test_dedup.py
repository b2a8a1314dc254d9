"""Substring, chunk and line dedup and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import chunk_dedup, graph, line_dedup, ngram_join, suffix_dedup
from foliant.llm.common import documents, utf8


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def brute_substrings(texts, size=100):
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            if s in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_odd(odd):
    texts, df = odd
    got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute_substrings(texts)


def test_substrings_documents(spark, sf):
    df = documents(spark, sf)
    texts = dict(rows(df, "doc_id", "text"))
    got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute_substrings(texts)


def test_substrings_crowded(spark, sf, monkeypatch):
    """With every anchor that occurs twice treated as very frequent, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    df = documents(spark, sf)
    got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute_substrings(dict(rows(df, "doc_id", "text")))


def test_substrings_repeated_and_empty(repeated, empty):
    got = rows(suffix_dedup.dedup_substrings(repeated), "doc_id", "n_bytes", "n_removed")
    assert len(got) == 6
    whole = sorted(g for d, n, g in got if n and n == g)
    assert len(whole) == 3  # all lie in the longer text, whose document comes first
    assert suffix_dedup.dedup_substrings(empty).collect() == []


def test_substrings_weak_hash(spark, monkeypatch):
    """Anchors and strings whose hashes agree are not taken for equal: bytes decide."""

    def weak(data, bounds, whole=suffix_dedup.Pieces):
        pieces = whole(data, bounds)
        pieces.hash = pieces.hash % np.uint64(5)
        return pieces

    def strings(pieces, crowded, whole=suffix_dedup._strings):
        one, doc, h = whole(pieces, crowded)
        return one, doc, h % np.uint64(7)

    rng = np.random.default_rng(4)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = word(150)
    texts = {i: word(120) + shared + word(120) for i in range(6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    want = brute_substrings(texts)
    monkeypatch.setattr(suffix_dedup, "_strings", strings)
    for crowd in (2048, 1):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        if crowd > 1:
            monkeypatch.setattr(suffix_dedup, "Pieces", weak)
        else:
            monkeypatch.undo()
            monkeypatch.setattr(suffix_dedup, "_strings", strings)
            monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        assert got == want


def thue_morse(n):
    """A word of two letters and its complement, which hashes of the polynomial kind take for equal."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse(spark, n):
    from foliant.llm import quality

    a, b = thue_morse(n)
    rng = np.random.default_rng(n)
    tail = "".join(chr(97 + x) for x in rng.integers(0, 26, 40))
    texts = {1: a, 2: b, 3: f"{a}\n{b}\n{tail}", 4: f"{b}\n{tail}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert components_of(df) == brute_components(texts)
    got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute_substrings(texts)
    assert dict(rows(chunk_dedup.dedup_chunks(df), "doc_id", "text")) == brute_chunks(texts)
    assert dict(rows(quality.quality_scores(df), "doc_id", "n_dup_lines")) == dict.fromkeys(texts, 0)


def test_substrings_of_a_long_text(spark):
    """Texts are cut into segments; strings across their borders are found as well."""
    rng = np.random.default_rng(6)
    body = bytes(rng.integers(97, 123, 600_000).astype(np.uint8)).decode()
    at = suffix_dedup.SEGMENT
    texts = {1: body, 2: body[at - 5000 : at + 5000], 3: "x" + body[2 * at - 150 : 2 * at + 20] + body[:99], 4: body[300_000:] + "ab" * 400}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: r[1:] for r in rows(suffix_dedup.dedup_substrings(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert got == brute_substrings(texts)


def test_blind_trie():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 99, 12).astype(np.uint8)) for _ in range(400)]
    trie = suffix_dedup.BlindTrie(texts[0], 0)
    for i, t in enumerate(texts[1:], 1):
        trie.add(t, i)
    got = [(t, sorted(m)) for t, m in trie.leaves()]
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert got == sorted((t, sorted(m)) for t, m in want.items())


def test_deep_shallow_orders_all_suffixes():
    data = np.frombuffer(b"abracadabra" * 30 + b"xyz" * 40, np.uint8)
    start, raw = np.arange(len(data) - 100), data.tobytes()
    for small in (1, 24):
        suffix_dedup.SMALL, kept = small, suffix_dedup.SMALL
        order, new = suffix_dedup.multikey_quicksort(suffix_dedup._words(data), start, np.zeros(len(start), np.int64), 4)
        suffix_dedup.SMALL = kept
        heads = [raw[s : s + 32] for s in order]
        assert heads == sorted(raw[s : s + 32] for s in start)
        assert new.tolist() == [k == 0 or heads[k] != heads[k - 1] for k in range(len(heads))]
    equal = defaultdict(list)
    for s in start.tolist():
        equal[raw[s : s + 100]].append(s)
    groups = list(suffix_dedup.deep_shallow(data, start))
    assert sorted(map(sorted, groups)) == sorted(g for g in equal.values() if len(g) > 1)
    strings = [raw[g[0] : g[0] + 100] for g in groups]
    assert strings == sorted(strings)


def test_quicksort_keeps_buckets_apart():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start, bucket = np.arange(3900), np.repeat(np.arange(39), 100)
    order, _ = suffix_dedup.multikey_quicksort(suffix_dedup._words(data), start, bucket, 3)
    assert (bucket[order] == bucket).all()
    raw = data.tobytes()
    assert [raw[s : s + 24] for s in order] == [x for k in range(39) for x in sorted(raw[s : s + 24] for s in range(100 * k, 100 * k + 100))]


def gear_of(b, p):
    """Gear hash of the 16 bytes before p."""
    from foliant.llm.common import BYTE_VALUE

    return sum((int(BYTE_VALUE[x]) >> 13) << k for k, x in enumerate(reversed(b[max(0, p - 16) : p]))) & 0xFFFF


def brute_bounds(b, least=48, most=256, bits=6):
    """Chunk bounds of one text, by the words of the docstring."""
    n = len(b)
    ends = [p + 1 for p in range(n) if b[p] == 10]
    fixed = {0, n}
    for k, p in enumerate(ends):
        if p - (ends[k - 1] if k else 0) >= least and n - p >= least:
            fixed.add(p)
    fixed = sorted(fixed)
    places = [p for p in range(1, n) if (gear_of(b, p) >> (16 - bits)) == 0 and b[p] & 0xC0 != 0x80]
    chosen = set(fixed)
    for k, p in enumerate(places):
        before, after = max(f for f in fixed if f <= p), min([f for f in fixed if f > p], default=n)
        if (k == 0 or p - places[k - 1] >= least) and p - before >= least and after - p >= least:
            chosen.add(p)
    out, cuts = [], sorted(chosen)
    for x, y in zip(cuts, cuts[1:]):
        out.append(x)
        while y - x >= most + least:
            x += most
            cut = x
            while cut < n and b[cut] & 0xC0 == 0x80:
                cut -= 1
            out.append(cut)
    return [*out, n] if n else [0]


def brute_chunks(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        raw, kept = (texts[i] or "").encode(), b""
        cuts = brute_bounds(raw)
        for a, b in zip(cuts, cuts[1:]):
            chunk = raw[a:b]
            line = chunk[:-1] if chunk.endswith(b"\n") else chunk
            if line not in seen:
                kept += chunk
            seen.add(line)
        out[i] = kept.decode()
    return out


def test_chunks(odd, spark, sf):
    for texts, df in (odd, (dict(rows(documents(spark, sf), "doc_id", "text")), documents(spark, sf))):
        got = dict(rows(chunk_dedup.dedup_chunks(df), "doc_id", "text"))
        assert got == brute_chunks(texts)


def test_chunks_of_lines(spark):
    """Lines and short documents that repeat go, whatever stands around them."""
    rng = np.random.default_rng(8)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    short, line = word(30), word(70)
    texts = {0: short, 1: short, 2: f"{word(60)}\n{line}\n{word(60)}", 3: f"{word(90)}\n{line}\n{word(80)}\n{line}", 4: short + word(30), 5: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = dict(rows(chunk_dedup.dedup_chunks(df), "doc_id", "text"))
    assert got == brute_chunks(texts)
    assert got[0] == short and got[1] == "" and got[2] == texts[2] and got[4] == texts[4]
    assert got[3] == texts[3].replace(line + "\n", "").removesuffix(line)


def test_chunks_resist_insertions():
    rng = np.random.default_rng(5)
    body = bytes(rng.integers(97, 123, 4000).astype(np.uint8))

    def cut(b: bytes) -> set[bytes]:
        c = chunk_dedup.boundaries(np.frombuffer(b, np.uint8), np.array([0, len(b)])).tolist()
        return {b[x:y] for x, y in zip(c, c[1:])}

    a, b = cut(body), cut(body[:2000] + b"INSERTED" + body[2000:])
    assert len(a & b) >= len(a) - 4


def test_chunks_are_the_texts_own():
    """A text is cut in the same way whatever stands before it in the buffer."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = [bytes(rng.integers(97, 123, int(rng.integers(0, 400))).astype(np.uint8)) for _ in range(6)]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        start, end, doc = chunk_dedup.chunks(np.frombuffer(b"".join(texts), np.uint8), bounds)
        for d, t in enumerate(texts):
            alone = chunk_dedup.chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
            assert (start[doc == d] - bounds[d]).tolist() == alone[0].tolist() and (end[doc == d] - bounds[d]).tolist() == alone[1].tolist()


def test_chunks_repeated_and_empty(repeated, empty):
    got = rows(chunk_dedup.dedup_chunks(repeated), "doc_id", "n_bytes", "n_removed")
    assert len(got) == 6 and sum(1 for _, n, g in got if n and n == g) == 2
    assert chunk_dedup.dedup_chunks(empty).collect() == []


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def components_of(df):
    return {r[0]: r[1:] for r in rows(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")}


def test_join_odd(odd):
    texts, df = odd
    assert components_of(df) == brute_components(texts)


@pytest.mark.parametrize("fragment", [20, 2 << 20])
def test_join_documents(spark, sf, monkeypatch, fragment):
    monkeypatch.setattr(ngram_join, "FRAGMENT", fragment)
    df = documents(spark, sf)
    assert components_of(df) == brute_components(dict(rows(df, "doc_id", "text")))


def crowd_texts():
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(150):
        t = list(base)
        for p in rng.choice(120, rng.integers(0, 6), replace=False):
            t[p] = f"e{i}x{p}"
        texts[i] = " ".join(t) if i % 5 else " ".join(f"o{i}y{k}" for k in range(30)) + " " + " ".join(base[:60])
    return texts


@pytest.mark.parametrize("split", [12, 3])
def test_join_crowds(spark, monkeypatch, split):
    """Many near copies of one text: with small crowds, blocks and pivots, the later rounds find the same components."""
    for name, value in (("CROWD", 3), ("PIVOTS", 1), ("MORE_PIVOTS", (2,)), ("LEAST", 2), ("BLOCK", 7), ("PAIRS", 4), ("SPLIT", split), ("FRAGMENT", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = crowd_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert components_of(df) == brute_components(texts)


def test_join_clashing_names(spark, monkeypatch):
    """Sets whose 64-bit names agree stay apart."""

    def weak(doc, h, docs, whole=ngram_join._signature):
        n, cid, check = whole(doc, h, docs)
        return n, cid % np.uint64(3), check

    monkeypatch.setattr(ngram_join, "_signature", weak)
    texts = {**{i: t for i, t in crowd_texts().items() if i < 20}, 20: "one two", 21: "one two", 22: "three", 23: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    assert components_of(df) == brute_components(texts)


def test_sketches_bound_the_overlap():
    """Never less than the overlap, also with full ranges; unlike sets of many shingles are told apart."""
    rng = np.random.default_rng(3)

    def sketch(h):
        return ngram_join._sketches(np.array([len(h)]), np.zeros(len(h), np.int64), h)[0].as_py()

    for n, m in ((1, 1), (9, 11), (300, 260), (2000, 1500), (1024, 1023)):
        a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (n, m))
        for share in (0, n // 2, min(n, m)):
            c = np.append(a[:share], b[share:m])
            assert ngram_join._most(sketch(a), sketch(c)) >= len(np.intersect1d(a, c))
        if n > 250:
            assert ngram_join._most(sketch(a), sketch(b)) < ngram_join._need(np.array(n), np.array(m))
    a = np.arange(2000, dtype=np.uint64)
    assert ngram_join._most(sketch(a), sketch(a)) >= 2000


def test_only_possible_pairs_are_verified(spark):
    """Of pairs that met, those with a passage in common only don't get their sets dealt out."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    passage, body = word(60), word(600)
    texts = {0: body, 1: body[:590] + word(10), 2: passage + word(500), 3: passage + word(520), 4: word(480) + passage}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    numbered, _ = ngram_join.identified(df)
    _, classes, _ = ngram_join.classified(numbered)
    sets = {r["rep"]: (r["cid"], len(shingles(" ".join(texts[r["rep"]])))) for r in classes.collect()}
    pairs = [(*sorted((sets[i][0], sets[j][0])), 0, 0) for i in sets for j in sets if i < j]
    size = dict(sets.values())
    pairs = spark.createDataFrame([(a, b, size[a], size[b]) for a, b, _, _ in pairs], "a long, b long, na long, nb long")
    assert [sorted(r[:2]) for r in ngram_join.possible(classes, pairs).collect()] == [[0, 1]]
    assert [sorted(r) for r in ngram_join.verified(numbered, classes, pairs).collect()] == [[0, 1]]


def test_links_of_each_document(spark, monkeypatch):
    """The join itself verifies every pair, in crowds as well."""
    monkeypatch.setattr(ngram_join, "CROWD", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = {i: t for i, t in crowd_texts().items() if i < 40}
    texts |= {100: texts[1], 101: texts[1], 102: "", 103: None}
    sets = {i: shingles(t) for i, t in texts.items()}
    want = {i: sum(1 for j, t in sets.items() if j != i and t and 100 * len(s & t) >= 75 * len(s | t)) for i, s in sets.items() if s}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert dict(rows(ngram_join.link_counts(df), "doc_id", "n_links")) == want


def test_join_repeated_and_empty(repeated, empty):
    got = rows(ngram_join.near_duplicates(repeated), "doc_id", "n_shingles", "component_id")
    assert len(got) == 6
    assert sorted(c for d, n, c in got if n > 100) == [2] * 4
    assert ngram_join.near_duplicates(empty).collect() == []


def test_keep_first(odd):
    texts, df = odd
    got = ngram_join.keep_first(df)
    assert got.columns == df.columns
    want = {i for i, (_, c) in brute_components(texts).items() if c == i}
    assert {r["doc_id"] for r in got.collect()} == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "ONE_TASK", most)
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (200, 201)]
    got = dict(rows(graph.components(spark.createDataFrame(pairs, "a long, b long")), "node", "label"))
    assert set(got[i] for i in range(1, 41)) == {1}
    assert {got[i] for i in (90, 95, 100)} == {90} and {got[200], got[201]} == {200}


def test_lines_sql(spark, sf):
    df = line_dedup.line_report(documents(spark, sf))
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({line_dedup.SQL})").fetchall()
    assert sorted(rows(df, "doc_id", "n_lines", "n_removed", "text")) == sorted(want)


def test_lines_rules(spark):
    data = [(i, f"footer line\nown text number {i} which is long enough to stay\nrare {i}", f"s{i}") for i in range(9)]
    data += [(50, "footer line", "s1"), (51, None, "s2"), (52, "", None), (53, "footer line\n\nfooter line\n" + "y" * 60, "s3")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["report"]["n_removed"]) for r in line_dedup.dedup_lines(df, report="report").collect()}
    assert got[0] == ("own text number 0 which is long enough to stay\nrare 0", 1)
    assert got[50] == ("", 1)
    assert got[51] == (None, 0) and got[52] == ("", 0)
    assert got[53] == ("\n" + "y" * 60, 2)


def test_lines_odd(odd, empty):
    texts, df = odd
    out = line_dedup.dedup_lines(df, min_sites=3, report="lines")
    assert out.columns == [*df.columns, "lines"]
    assert out.count() == len(texts)
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, report="row")
    assert line_dedup.dedup_lines(empty).collect() == []


def test_near_threshold_is_exact(spark):
    """A line on exactly the threshold of sites is boilerplate, one on a site less isn't."""
    data = [(i, f"at threshold\nbody {i} " + "z" * 40, f"s{i}") for i in range(8)] + [(100 + i, f"under threshold\nbody {i} " + "z" * 40, f"s{i}") for i in range(7)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == 1 for i in range(8)) and all(got[100 + i] == 0 for i in range(7))


def test_lines_beyond_the_broadcast(spark, monkeypatch):
    """Very frequent lines are looked up by a broadcast, the others by a shuffle; the result is the same."""
    from foliant.llm import common

    data = [(i, f"everywhere\nsome {i % 3}\nown {i}", f"s{i}") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = sorted(rows(line_dedup.line_report(df), "doc_id", "n_removed", "text"))
    for module in (common, line_dedup):
        monkeypatch.setattr(module, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(common, "KEY_ROWS", 30)
    assert sorted(rows(line_dedup.line_report(df), "doc_id", "n_removed", "text")) == want
    assert want[0] == (0, 2, "own 0")


def test_clashing_and_dotted_columns(spark, sf):
    """Stages take columns whose names hold dots, clash with theirs or differ in case only."""
    import corpus_pipeline

    names = ["doc_id", "text", "source", "n_chars", "a.b", "_n_removed", "uid", "TEXT", "row", "c0"]
    body = " ".join(f"w{i}" for i in range(60))
    data = [(i, f"{body} {i} x{i} y{i} z{i} {i * 7}\nfooter", f"s{i}", 3, "d", 1, 2, "t", "r", "c") for i in range(9)]
    schema = "doc_id long, text string, source string, n_chars long, ab string, nr long, uid long, t2 string, row string, c0 string"
    df = spark.createDataFrame(data, schema).toDF(*names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == names
    got = df.collect()
    assert [r[0] for r in got] == [0] and got[0][1] == data[0][1].removesuffix("\nfooter") and got[0][3] == len(got[0][1])
    assert list(got[0])[4:] == ["d", 1, 2, "t", "r", "c"]


def test_lines_of_any_length(spark):
    """A repeated line of over 300 characters is boilerplate too."""
    long = "a notice that stands on every site " * 15
    data = [(i, f"{long}\n" + f"own text {i} " * 60, f"s{i}") for i in range(8)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.line_report(df).collect()}
    assert got == {i: (1, f"own text {i} " * 60) for i in range(8)}


def test_lines_of_any_share(spark):
    """A boilerplate line goes also where it is most of a text or all of it."""
    data = [(i, "a footer on every site\n" + f"own text {i} " * 40, f"s{i}") for i in range(8)]
    data += [(20, "a footer on every site\nshort", "s1"), (21, "a footer on every site", "s2"), (22, "a footer on every site\na footer on every site\n", "s3")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_report(df).collect()}
    assert got[0] == (2, 1, "own text 0 " * 40)
    assert got[20] == (2, 1, "short") and got[21] == (1, 1, "") and got[22] == (3, 2, "")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_spans(n):
    from foliant.llm.deal import spans_of

    rng = np.random.default_rng(n)
    a = rng.integers(0, 50, 20)
    b = a + rng.integers(1, 8, 20)
    covered = sorted({p for x, y in zip(a.tolist(), b.tolist()) for p in range(x, y)})
    s, e = spans_of(a, b)
    assert sorted(p for x, y in zip(s.tolist(), e.tolist()) for p in range(x, y)) == covered
    assert all(y < x for x, y in zip(s[1:].tolist(), e[:-1].tolist()))
