"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes.  Chunks end at line ends, and where the low bits of
the hash are zero.  Places closer than LEAST bytes to the one before (line ends first, then
hash places between them) don't count, and after MOST bytes a chunk ends anyhow.  All of
this looks only at the bytes nearby, so an insertion moves no boundary far away, and a line
of LEAST bytes after another such line has the same chunks whatever else stands around it.
So every chunk has about LEAST bytes or more, but for a shorter document, which is one chunk.

Every chunk but the first of its 128-bit digest (without its line end), in order of document
and place, is a repeat and is taken out.

Tasks decide about repeats among their own chunks and send only the first of each digest
on, so a chunk that is everywhere makes one record for each task.

Defined cases: null and empty texts have no chunks and give an empty text; repeated rows
and null ids: the rows are taken in order of id (nulls last) and text, and the first
keeps its text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import BYTE_VALUE, identified, partitions, slices, text_bytes, utf8
from .deal import ABOUT, DEALT, about, by_fragment, deal, dealt_rows, fragment_of, fragments_of, gathered, spans_of, undeal, with_records

#: A place every 2**BITS bytes on average; least and most bytes of a chunk.
BITS, LEAST, MOST = 6, 48, 256
#: Bytes that the gear hash looks at.
WINDOW = 16
#: Removed runs of this many bytes are passages rather than lines (counted in n_passages).
PASSAGE = 256
HELD = 1 << 18

_GEAR = (BYTE_VALUE >> np.uint64(13)).astype(np.uint32)
_NONE = np.empty(0, np.int64)


def gear(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The gear hash of the last WINDOW bytes at each place: each byte's value shifted by its distance.

    It starts anew in each text, so a text's chunks don't depend on what stands before it in the buffer.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    start, size = bounds[:-1], np.diff(bounds)
    for k in range(WINDOW - 1):
        at = start[size > k] + k
        h[at] = _GEAR[data[at]] + (h[at - 1] << np.uint32(1) if k else 0)
    return h


def boundaries(data: np.ndarray, bounds: np.ndarray, bits: int = BITS, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """All chunk bounds of a buffer of documents, their own bounds included, in order."""
    n = len(data)

    def far(place: np.ndarray) -> np.ndarray:
        return place[np.append(True, np.diff(place) >= least)] if len(place) else place

    # Line ends: those that have `least` bytes to the line end or text bound before, and to the text's end.
    lines = np.flatnonzero(data == 10) + 1
    doc = np.searchsorted(bounds, lines, "left") - 1
    before = np.maximum(np.append(-n, lines[:-1])[: len(lines)], bounds[doc])
    lines = lines[(lines - before >= least) & (bounds[doc + 1] - lines >= least)]
    fixed = np.union1d(lines, bounds)
    # Places of the hash: whole characters only, and `least` bytes from those bounds.
    place = np.flatnonzero((gear(data, bounds) >> np.uint32(16 - bits)) & np.uint32((1 << bits) - 1) == 0) + 1
    place = place[place < n]
    place = far(place[(data[place] & 0xC0) != 0x80])
    k = np.searchsorted(fixed, place, "right")
    place = place[(place - fixed[k - 1] >= least) & (fixed[np.minimum(k, len(fixed) - 1)] - place >= least)]
    cuts = np.union1d(place, fixed)
    more = np.maximum(0, (np.diff(cuts) - least) // most)
    if more.any():
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = np.repeat(cuts[:-1], more) + most * step
        for _ in range(3):
            extra = extra - ((extra < n) & ((data[np.minimum(extra, n - 1)] & 0xC0) == 0x80))
        cuts = np.union1d(cuts, extra)
    return cuts


def chunks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document of each chunk."""
    if not len(data):
        return _NONE, _NONE, _NONE
    cuts = boundaries(data, bounds)
    start, end = cuts[:-1], cuts[1:]
    return start, end, np.searchsorted(bounds, start, "right") - 1


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two numbers for each chunk: the 128 bits of its digest, without its line end."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    stop = end - (data[end - 1] == 10)
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist())]), "<u8").reshape(-1, 2)


def _not_first(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    same = np.zeros(len(order), dtype=bool)
    if len(order):
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return same


def repeats(numbered: DataFrame, size: int) -> DataFrame:
    """For each document the starts of its chunks that occur earlier (rows of deal.ABOUT)."""
    parts = partitions(numbered.sparkSession, size)
    fragments = fragments_of(parts, size)
    kinds = ["<u8", "<u8", "<i8", "<u4"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            a, b, uid, start = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((start, uid, b, a))
            again = _not_first(order, a, b)
            first, known = order[~again], order[again]
            numbers, blobs = deal(fragment_of(a[first], fragments), [c[first] for c in (a, b, uid, start)])
            # What is known here goes along to any fragment, as records about a document.
            return dealt_rows(numbers, blobs, *deal(uid[known], [start[known].astype("<u4")]), fragments)

        for part in slices(batches):
            data, bounds = utf8(part.column(1))
            start, end, doc = chunks(data, bounds)
            if not len(start):
                continue
            both = digests(data, start, end)
            held.append((both[:, 0], both[:, 1], np.asarray(part.column(0))[doc], (start - bounds[doc]).astype("<u4")))
            total += len(start)
            if total >= HELD:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, blobs in by_fragment(batches):
            if fragment is None:
                yield blobs
                continue
            a, b, uid, start = undeal(blobs, kinds)
            order = np.lexsort((start, uid, b, a))
            again = order[_not_first(order, a, b)]
            if len(again):
                yield about(uid[again], [start[again]])

    return gathered(numbered.select("uid", "text").mapInArrow(send, DEALT), parts).mapInArrow(meet, ABOUT)


SCHEMA = "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, n_passages long, text string"


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """One row per document: what was taken out (bytes, runs, and runs of PASSAGE bytes), and the text that is left."""
    numbered, _ = identified(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            data, bounds = utf8(part.column(2))
            start, end, doc = chunks(data, bounds)
            ends = np.searchsorted(doc, np.arange(part.num_rows), "right")
            rows, raw = [], data.tobytes()
            for d, records in enumerate(part.column(3).to_pylist()):
                low, high = int(ends[d - 1]) if d else 0, int(ends[d])
                at, end_of = int(bounds[d]), int(bounds[d + 1])
                (again,) = undeal(records or [], ["<u4"])
                again = low + np.searchsorted(start[low:high] - at, np.sort(again))
                a, b = spans_of(start[again], end[again])
                long = int((b - a >= PASSAGE).sum())
                a, b = a.tolist(), b.tolist()
                kept = b"".join([raw[x:y] for x, y in zip([at, *b], [*a, end_of])])
                rows.append((end_of - at, high - low, end_of - at - len(kept), len(a), long, kept.decode()))
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(1), *arrays], [c.split()[0] for c in SCHEMA.split(", ")])

    return with_records(numbered, repeats(numbered, text_bytes(numbered))).mapInArrow(run, SCHEMA)
