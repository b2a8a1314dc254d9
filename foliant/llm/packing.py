"""Packing of tokenised documents into training windows by multiway differencing.

A document's ids (with an end id) are cut into full windows; what is left of it is cut into
pieces of at most a quarter of a window, since longer ones can't be dealt evenly.  The pieces
of one input partition are gathered into groups of GROUP windows' worth, less ROOM (the last
piece of a group is cut where the group is full), and each group is dealt to windows by the multiway form
of Karmarkar and Karp's differencing: partial partitions are merged largest spread
first, the fullest window of one with the emptiest of the other.  Where a window
exceeds its capacity the number of windows rises by one and the group is dealt again.

A partial partition keeps its windows that hold anything, so the memory of a group is that
of its pieces.  No row is shuffled: every partition packs its own documents, holds one group
at a time, and gives windows ids from its partition number, so a lost task gives the same
rows again.

Defined cases: a null or empty text is its end id alone; rows that repeat a doc_id are
documents of their own, and a null id stays null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, texts
from .tokens import encoder

#: Ids in a window, windows in a group, and the part of a window that a full group leaves free in each.
WINDOW, GROUP, ROOM = 2048, 256, 1 / 128


def _merged(a: list, b: list, k: int) -> list:
    """Two partial partitions into k windows as one: fullest with emptiest, windows in rising order."""
    if len(a) < len(b):
        a, b = b, a
    both = max(0, len(a) + len(b) - k)  # so many of each don't meet an empty window
    # Windows are (sum, tie-break, members); the smaller list of members joins the larger.
    joined = []
    for (x, i, mine), (y, j, other) in zip(a[:both], reversed(b[:both])):
        if len(mine) < len(other):
            mine, other = other, mine
        mine.extend(other)
        joined.append((x + y, min(i, j), mine))
    joined += b[both:]
    rest = a[both:]
    if len(joined) > 16:
        return sorted(rest + joined)
    for window in joined:
        insort(rest, window)
    return rest


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in k parts of nearly equal sum."""
    # (minus the spread, tie-break, windows that hold anything); an empty window makes the spread the largest sum.
    heap = [(-size if k > 1 else 0, i, [(size, i, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        first, second = heapq.heappop(heap), heapq.heappop(heap)
        windows = _merged(first[2], second[2], k)
        heapq.heappush(heap, ((windows[0][0] if len(windows) == k else 0) - windows[-1][0], tie, windows))
        tie += 1
    parts = [members for _, _, members in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts that each hold at most `capacity`: as many as it takes with ROOM to spare, and more as long as any is over."""
    k = max(1, -(-sum(sizes) // (capacity - int(ROOM * capacity))))
    while True:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        k += 1


class Packer:
    """Pieces of one partition: full ones leave at once, others wait for their group."""

    def __init__(self, capacity: int, group: int, with_ids: bool):
        self.capacity, self.quarter, self.with_ids = capacity, max(1, capacity // 4), with_ids
        self.full = group * (capacity - int(ROOM * capacity))
        self.waiting: list[tuple] = []
        self.total = 0

    def add(self, doc_id, ids: bytes) -> Iterator[list[tuple]]:
        n, at = len(ids) // 4, 0
        while at < n:
            size = min(self.capacity, n - at)
            if size < self.capacity:
                size = min(size, self.quarter, self.full - self.total)
            part = ids[4 * at : 4 * (at + size)]
            piece = (doc_id, at, size, zlib.crc32(part), n, part if self.with_ids else b"")
            at += size
            if size == self.capacity:
                yield [piece]
            else:
                self.waiting.append(piece)
                self.total += size
                if self.total >= self.full:
                    yield from self.flush()

    def flush(self) -> Iterator[list[tuple]]:
        if self.waiting:
            for part in windows_of([p[2] for p in self.waiting], self.capacity):
                yield [self.waiting[i] for i in part]
        self.waiting, self.total = [], 0


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = WINDOW, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, and its window and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(vocabulary).encode, Packer(capacity, group, with_ids)
        end, sequence = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(window: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for piece in window:
                rows.append((*piece[:5], sequence, offset, piece[5]))
                offset += piece[2]
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 8
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for part in slices(batches):
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                for window in packer.add(doc_id, ids + end):
                    place(window)
            if len(rows) > 20_000:
                yield out()
        for window in packer.flush():
            place(window)
        yield out()

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(run, schema)
