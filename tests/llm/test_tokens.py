"""Tokenisation, packing, the token store and the pipeline."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import packing, token_store, tokens
from foliant.llm.common import documents


VOCABULARY = tokens.public_vocabulary()


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(reference):
    rng = random.Random(0)
    texts = [None, "", " ", "\n", "a\n", "\na", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "x\x1cy z", "x \x85y", "it's I'll 's", "tab\t x\t\ty", "<|endoftext|> hi", "é,. ü!! ñ&&&", "3.14, 2,718 v2.0.", "don't!", "😀 😀\n😀"]
    texts += ["".join(rng.choice("ab ,.\n\t'é1😀") for _ in range(40)) for _ in range(2000)]
    for most in (5, 1000):
        encoder = tokens.Encoder(VOCABULARY, most)
        assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(texts)] == [reference(t) for t in texts]


def test_documents_ids(spark, sf, reference):
    texts = [r["text"] for r in documents(spark, sf).collect()]
    got = tokens.Encoder(VOCABULARY).encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [reference(t) for t in texts]


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sizes = [rng.randint(1, 2047) for _ in range(150)]
    parts = packing.differencing(sizes, 40)
    assert sorted(i for p in parts for i in p) == list(range(150))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) < 200
    windows = packing.windows_of(sizes, 2048)
    assert all(sum(sizes[i] for i in p) <= 2048 for p in windows)
    assert packing.windows_of([2048, 2048, 1], 2048).__len__() == 3


def test_differencing_merges_fullest_with_emptiest():
    """The sums are those of the plain definition: tuples with zeros, largest spread first, one reversed."""
    import heapq

    rng = random.Random(7)
    for _ in range(60):
        sizes, k = [rng.randint(1, 90) for _ in range(rng.randint(1, 40))], rng.randint(1, 9)
        heap = [(-s if k > 1 else 0, i, sorted([s] + [0] * (k - 1))) for i, s in enumerate(sizes)]
        heapq.heapify(heap)
        tie = len(sizes)
        while len(heap) > 1:
            a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
            both = sorted(x + y for x, y in zip(a, reversed(b)))
            heapq.heappush(heap, (both[0] - both[-1], tie, both))
            tie += 1
        got = packing.differencing(sizes, k)
        assert sorted(i for p in got for i in p) == list(range(len(sizes)))
        assert sorted(sum(sizes[i] for i in p) for p in got) == heap[0][2]


def test_padding_of_a_corpus():
    """Under one per cent where a partition holds many groups."""
    rng = random.Random(5)
    packer, total, windows = packing.Packer(2048, packing.GROUP, False), 0, 0
    for d in range(5000):
        n = int(rng.expovariate(1 / 700)) + 1
        total += n
        windows += sum(1 for _ in packer.add(d, bytes(4 * n)))
    windows += sum(1 for _ in packer.flush())
    assert total / (2048 * windows) > 0.99


def check_packing(rows, texts, reference, capacity):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for d, pieces in by_doc.items():
        ids = np.array([*reference(texts[d]), 1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
        total += at
    for pieces in by_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return total / (len(by_window) * capacity)


def test_packing_documents(spark, sf, reference):
    df = documents(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    fill = check_packing(packing.pack(df, VOCABULARY).collect(), texts, reference, 2048)
    assert fill > 0.93


def test_packing_odd(odd, repeated, empty, reference):
    texts, df = odd
    check_packing(packing.pack(df, VOCABULARY).collect(), texts, reference, 2048)
    assert packing.pack(repeated, VOCABULARY).agg({"length": "sum"}).first()[0] > 0
    assert packing.pack(empty, VOCABULARY).collect() == []


def test_packing_gives_ids(odd, reference):
    texts, df = odd
    rows = packing.pack(df, VOCABULARY, with_ids=True).collect()
    for r in rows:
        whole = [*reference(texts[r["doc_id"]]), 1]
        assert r["ids"] == whole[r["start"] : r["start"] + r["length"]]


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_shard_round_trip():
    rng = random.Random(2)
    docs = {u: np.array([rng.randrange(50000) for _ in range(rng.choice([1, 3, 4000]))], "<u4").tobytes() for u in sorted(rng.sample(range(-(10**12), 10**12), 300))}
    for width in (2, 4):
        out = File()
        writer = token_store.ShardWriter(out, width)
        for u, ids in docs.items():
            writer.add(u, ids)
        writer.close()
        reader = token_store.ShardReader(out)
        assert list(reader.scan()) == list(docs.items())
        assert reader.documents == 300 and len(reader.index) > 3
        assert all(reader.get(u) == docs[u] for u in list(docs)[::7])
        misses = [u + 1 for u in docs if u + 1 not in docs]
        assert all(reader.get(u) is None for u in misses)
        passed = sum(all(reader.field[p >> 3] >> (p & 7) & 1 for p in token_store._probes(token_store.key_of(u), reader.bits, reader.probes)) for u in misses)
        assert passed < 0.1 * len(misses)


def test_keys_sort_as_numbers():
    numbers = [-(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]
    keys = [token_store.key_of(n) for n in numbers]
    assert keys == sorted(keys) and [token_store.uid_of(k) for k in keys] == numbers


def test_store(spark, sf, odd, reference):
    for df in (documents(spark, sf), odd[1]):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.store_round_trip(df, VOCABULARY).collect()}
        start, want = 0, {}
        for d in sorted(texts):
            ids = np.array([*reference(texts[d]), 2], dtype="<u4")
            want[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert got == want


def test_store_repeated_and_empty(repeated, empty):
    got = token_store.store_round_trip(repeated, VOCABULARY).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 2), (False, 5), (False, 5), (False, 7), (True, 0), (True, 0)]
    assert sorted(r["start"] for r in got)[0] == 0
    assert token_store.store_round_trip(empty, VOCABULARY).collect() == []


def test_pipeline(spark, sf, tmp_path, reference):
    """Stage by stage as the checker runs it, each against its own brute force; and run() gives the same rows."""
    from .test_dedup import brute_components
    from .test_scans import brute_leaks, brute_quality

    docs = documents(spark, sf)
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "decontamination", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        if name == "packing":
            texts = {i: r["text"] for i, r in before.items()}
            check_packing(docs.collect(), texts, reference, 2048)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        texts = {i: r["text"] for i, r in before.items()}
        if name == "quality_rules":
            assert set(after) == {i for i, t in texts.items() if brute_quality(t)[6]}
        elif name == "line_dedup":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
            sites = {}
            for r in before.values():
                for x in set(r["text"].split("\n")):
                    sites.setdefault(x.strip(" "), set()).add(r["source"])
            bad = {x for x, s in sites.items() if x and len(s - {None}) >= 8}
            assert {i: r["text"] for i, r in after.items()} == {i: "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in bad) for i, r in before.items()}
        elif name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute_components(texts).items() if c == i}
        else:
            items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            assert set(after) == set(texts) - {d for d, _ in brute_leaks(texts, items)}
        before = after
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert sum(r["length"] for r in docs.collect()) == sum(r["length"] for r in corpus_pipeline.run(spark, sf).collect())
    assert {x[0] for x in key(docs.collect())} == set(before)


def test_stages_take_empty_tables(spark, sf, empty):
    docs = documents(spark, sf).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
