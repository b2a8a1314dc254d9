"""Benchmark decontamination by SimHash over windows of each item's size.

Items are the stated query set.  Tasks prepare them: number of words, shingles with their
counts, and a fingerprint of BITS bits, a SimHash weighted by shingle counts.  They go out in
blocks of at most ITEM_BYTES, and each block's index to every task.

In a document only windows of an item's number of words matter, of whose shingles at least
SIMILARITY are shingles of some item (others cannot reach it).  They get a fingerprint as
well.  The index holds, for each of BLOCKS blocks of 16 bits, the items by value.  As
RADIUS < 4 * BLOCKS, a fingerprint within RADIUS differs in at most 3 bits in some block, so
looking up all values within 3 bits of each block (among the items of the window's size)
finds every item within RADIUS.  Of those
the exact weighted Jaccard similarity of shingle counts decides.  Two windows of similarity
0.75 differ in about 44 of 256 bits with a deviation of 6, so RADIUS is over three deviations
away for the least similar pairs that count, and further for all others.

Defined cases: null and empty texts hold nothing and null or empty items are in nothing;
an item of fewer than five words is one shingle and is found where its words stand in
a row; repeated rows are judged alone; an empty table or benchmark changes nothing;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_position, fmix, place_of, slices, spread, texts, utf8, window_hashes

SIZE, SIMILARITY = 5, 0.75
BITS, BLOCKS, RADIUS = 256, 16, 63
#: Bytes that one block of items takes in a task, and shingles whose fingerprints are summed at a time.
ITEM_BYTES, SPAN = 64 << 20, 1 << 14
#: Values looked up or gone through at a time.
LOOK_UP = 1 << 20

_U = np.uint64
_BITS = np.arange(64, dtype=_U)
_SALTS = [_U(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
#: All values of 16 bits with at most 3 bits set.
NEAR = np.array(sorted(sum(1 << b for b in c) for k in range(4) for c in combinations(range(16), k)), dtype=np.uint16)

ITEMS = "item_id long, n_words long, fingerprint binary, shingles binary, counts binary"


def _sums(h: np.ndarray) -> np.ndarray:
    """Running sums of 1 or -1 for each bit of the hashes, a row of zeros first."""
    out = np.zeros((len(h) + 1, BITS), dtype=np.int32)
    for k, salt in enumerate(_SALTS):
        bits = ((fmix(h ^ salt)[:, None] >> _BITS) & _U(1)).astype(np.int8) * 2 - 1
        np.cumsum(bits, axis=0, dtype=np.int32, out=out[1:, 64 * k : 64 * k + 64])
    return out


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Rows of BLOCKS values of 16 bits."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def prepared(benchmark: DataFrame) -> DataFrame:
    """The items as rows of the kind ITEMS; those without a word or id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(*utf8(part.column(1)), lower=True)
            hashes = {}
            for k in range(1, SIZE + 1):
                at, h = window_hashes(words, k)
                hashes[k] = (np.searchsorted(at, words.before[:-1]), h)
            rows = []
            for i, n in enumerate(words.counts.tolist()):
                if n:
                    k = min(SIZE, n)
                    first, h = hashes[k]
                    h = h[first[i] : first[i] + n - k + 1]
                    kinds, count = np.unique(h, return_counts=True)
                    rows.append((part.column(0)[i].as_py(), n, _fingerprints(_sums(h)[-1:]).tobytes(), kinds.astype("<u8").tobytes(), count.astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [c.split()[0] for c in ITEMS.split(", ")])

    plain, names = by_position(benchmark)
    items = plain.select(F.col(f"c{place_of(names, 'item_id')}").cast("long").alias("item_id"), F.col(f"c{place_of(names, 'text')}").cast("string").alias("text"))
    return items.filter("item_id is not null and text is not null").mapInArrow(run, ITEMS)


class Index:
    """A block of items: shingles and counts item after item, and for each block of the fingerprint the items by value."""

    def __init__(self, rows: list):
        self.ids = np.array([r["item_id"] for r in rows], dtype=np.int64)
        self.words = np.array([r["n_words"] for r in rows], dtype=np.int64)
        self.prints = np.frombuffer(b"".join(r["fingerprint"] for r in rows), "<u2").reshape(-1, BLOCKS)
        self.shingles = np.frombuffer(b"".join(r["shingles"] for r in rows), "<u8")
        self.counts = np.frombuffer(b"".join(r["counts"] for r in rows), "<u4")
        self.begin = np.cumsum([0, *(len(r["counts"]) // 4 for r in rows)])
        self.classes = {int(n): np.flatnonzero(self.words == n) for n in np.unique(self.words)}
        # Of a class with many items also the items by value, block by block.
        self.by_value = {}
        for n, items in self.classes.items():
            if len(items) > len(NEAR):
                order = np.argsort(self.prints[items], axis=0, kind="stable")
                self.by_value[n] = items[order], np.take_along_axis(self.prints[items], order, axis=0)
        size = np.minimum(SIZE, self.words)
        #: by shingle size: the sizes of items in words, and all their shingles
        self.sizes = {int(k): np.unique(self.words[size == k]) for k in np.unique(size)}
        of = np.repeat(size, np.diff(self.begin))
        self.known = {k: np.unique(self.shingles[of == k]) for k in self.sizes}

    def look_up(self, prints: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of prints, item of n_words words) within RADIUS.

        The values of a block that are within 3 bits are looked up among those of the class, or,
        where the class has fewer values than there are near ones, its values are gone through.
        """
        items, found = self.classes.get(n_words, np.empty(0, np.int64)), []
        if n_words not in self.by_value:
            step = max(1, LOOK_UP // (BLOCKS * max(1, len(items))))
            for low in range(0, len(prints), step):
                away = np.bitwise_count(prints[low : low + step, None, :] ^ self.prints[items][None]).sum(axis=2)
                row, col = np.nonzero(away <= RADIUS)
                found.append((row + low, items[col]))
            return (np.concatenate([r for r, _ in found]), np.concatenate([i for _, i in found])) if found else (items[:0], items[:0])
        held, values = self.by_value[n_words]
        step = max(1, LOOK_UP // len(NEAR))
        for low in range(0, len(prints), step):
            some = prints[low : low + step]
            for b in range(BLOCKS):
                value = some[:, b, None] ^ NEAR
                first = np.searchsorted(values[:, b], value, "left")
                count = np.searchsorted(values[:, b], value, "right") - first
                row, col = np.nonzero(count)
                n = count[row, col]
                item = held[np.repeat(first[row, col], n) + spread(n), b]
                found.append(np.repeat(row + low, n) * len(self.ids) + item)
        pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        row, item = pair // max(1, len(self.ids)), pair % max(1, len(self.ids))
        close = _distance(prints[row], self.prints[item]) <= RADIUS
        return row[close], item[close]

    def similarity(self, kinds: np.ndarray, count: np.ndarray, item: int) -> float:
        """Weighted Jaccard of a window's shingles (sorted, with counts) and an item's, of one total."""
        own, times = self.shingles[self.begin[item] : self.begin[item + 1]], self.counts[self.begin[item] : self.begin[item + 1]]
        spot = np.minimum(np.searchsorted(own, kinds), len(own) - 1)
        same = own[spot] == kinds
        common, total = int(np.minimum(times[spot[same]], count[same]).sum()), int(count.sum())
        return common / (2 * total - common)


def find(words: Words, index: Index, similarity: float = SIMILARITY) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(document, item id) -> best similarity, first word of that window, its words."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, sizes in index.sizes.items():
        at, h = window_hashes(words, k)
        known = index.known[k]
        if not len(at):
            continue
        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        if not hit.any():
            continue
        # Only documents with enough hits for the smallest item; their shingles in a row.
        least = int(np.ceil(similarity * (sizes[0] - k + 1)))
        per_doc = np.bincount(words.doc[at[hit]], minlength=words.docs)
        inside = per_doc[words.doc[at]] >= least
        at, h, hit = at[inside], h[inside], hit[inside]
        if not len(at):
            continue
        doc = words.doc[at]
        hits = np.concatenate([[0], np.cumsum(hit)])
        whole = _sums(h) if len(h) <= SPAN else None  # else span by span
        for n in sizes.tolist():
            m = n - k + 1
            if len(at) < m:
                continue
            need = int(np.ceil(similarity * m))
            starts = np.flatnonzero((hits[m:] - hits[:-m] >= need) & (doc[: len(at) - m + 1] == doc[m - 1 :]))
            while len(starts):  # windows that lie within one span of shingles
                low = int(starts[0])
                some = starts[: max(1, int(np.searchsorted(starts, low + SPAN)))]
                starts = starts[len(some) :]
                if whole is not None:
                    sums, low = whole, 0
                else:
                    sums = _sums(h[low : int(some[-1]) + m])
                window, item = index.look_up(_fingerprints(sums[some - low + m] - sums[some - low]), n)
                last, kinds, count = -1, None, None
                for w, i in zip(window.tolist(), item.tolist()):
                    if w != last:
                        last, (kinds, count) = w, np.unique(h[some[w] : some[w] + m], return_counts=True)
                    score = index.similarity(kinds, count, i)
                    if score >= similarity:
                        place = int(some[w])
                        key, first = (int(doc[place]), int(index.ids[i])), int(at[place] - words.before[doc[place]])
                        if key not in best or (-score, first) < (-best[key][0], best[key][1]):
                            best[key] = (score, first, n)
    return best


def blocks_of(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[Index]:
    """Indexes over the items, each of at most about `most` bytes; prepared items are read one after another."""
    rows, size = [], 0
    for row in prepared(benchmark).toLocalIterator():
        own = 2 * len(row["shingles"]) + len(row["counts"]) + 6 * BLOCKS + len(row["fingerprint"]) + 16
        if rows and size + own > most:
            yield Index(rows)
            rows, size = [], 0
        rows.append(row)
        size += own
    if rows:
        yield Index(rows)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first word, words."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    spark, out = docs.sparkSession, None
    source = texts(docs)
    for index in blocks_of(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = find(Words(*utf8(part.column(1)), lower=True), held.value, similarity)
                if found:
                    ids = part.column(0).take(pa.array([d for d, _ in found]))
                    rest = [pa.array([i for _, i in found], pa.int64()), *(pa.array(c) for c in zip(*found.values()))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        more = source.mapInArrow(run, schema)
        out = more if out is None else out.unionByName(more)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents in which no item is found, with all their columns; no shuffle."""
    spark = docs.sparkSession
    plain, names = by_position(docs)
    at = place_of(names, "text")
    for index in blocks_of(benchmark):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, at):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[d for d, _ in find(Words(*utf8(part.column(at)), lower=True), held.value, similarity)]] = False
                yield part.filter(pa.array(keep))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*names)
