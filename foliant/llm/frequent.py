"""The most frequent of many hashes, counted over all rows, as a bounded table.

Tasks send the upper 32 bits of each kind of hash, sorted, as steps of 16 bits with counts
to fragments of the hash space; a fragment adds up its own.  Only counts from `least` on are reported, by
level (log2 of the count).  The table has at most MOST entries: from the highest level down
as many levels as fit.  Of N hashes fewer than N / c can occur over c times, so what is left
out occurs less than 2 N / MOST times, or less than `least`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .deal import by_fragment, deal, fragments_of, gathered, undeal

#: Entries of the table, hashes that a task holds before it sends them, and the most that one entry counts.
MOST, HELD, MOST_IN_ENTRY = 1 << 20, 1 << 20, 255

_U = np.uint64


def frequent_prints(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, size: int = 0, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of hashes that occur at least `least` times (or as often as fits), sorted, and their levels.

    A print may stand for several hashes, so it says that a hash may be frequent.  `size` is
    the bytes of text behind the rows.
    """
    parts = partitions(rows.sparkSession, size)
    fragments = fragments_of(parts, size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(held), return_counts=True)
            entries = (n - 1) // MOST_IN_ENTRY + 1  # a print that the task has seen very often takes several
            prints, count = np.repeat(kinds, entries), np.full(int(entries.sum()), MOST_IN_ENTRY)
            count[np.cumsum(entries) - 1] = n - MOST_IN_ENTRY * (entries - 1)
            fragment = (prints.astype(_U) * _U(fragments)) >> _U(32)
            base = ((fragment << _U(32)) + _U(fragments - 1)) // _U(fragments)  # the least print of the fragment
            base[1:] = np.where(fragment[1:] == fragment[:-1], prints[:-1].astype(_U), base[1:])
            way = prints.astype(np.int64) - base.astype(np.int64)
            more = way // 65535  # a step of 65535 goes on to the next
            steps, counts = np.full(len(prints) + int(more.sum()), 65535, dtype="<u2"), np.zeros(len(prints) + int(more.sum()), dtype="u1")
            at = np.cumsum(more + 1) - 1
            steps[at], counts[at] = (way - 65535 * more).astype(np.uint16), count.astype(np.uint8)
            numbers, blobs = deal(np.repeat(fragment.astype(np.int64), more + 1), [steps, counts])
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["fragment", "blob"])

        for h in hashes(batches):
            held.append((h >> _U(32)).astype(np.uint32))
            total += len(h)
            if total >= HELD:
                yield out()
                held, total = [], 0
        if total:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, blobs in by_fragment(batches):
            base = -(-(fragment << 32) // fragments)
            found, times = [], []
            for data in blobs:
                steps, counts = undeal([data], ["<u2", "u1"])
                own = steps != 65535
                found.append((np.cumsum(steps.astype(np.int64)) + base)[own])
                times.append(counts[own])
            prints, times = np.concatenate(found), np.concatenate(times).astype(np.int64)
            order = np.argsort(prints, kind="stable")
            prints, times = prints[order], times[order]
            at = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
            n = np.add.reduceat(times, at)
            at, n = at[n >= least], n[n >= least]
            level = np.log2(n).astype(np.int64)
            for x in np.unique(level).tolist():
                chosen = prints[at[level == x]].astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([len(chosen)]), pa.array([chosen.tobytes()], pa.binary())], ["level", "n", "prints"])

    sent = rows.mapInArrow(send, "fragment long, blob binary")
    table = cut(gathered(sent, parts).mapInArrow(count, "level long, n long, prints binary"))
    sizes = {r["level"]: r["n"] for r in table.groupBy("level").agg(F.sum("n").alias("n")).collect()}
    first, total = max(sizes, default=0) + 1, 0
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        first = level
    found = [(r["level"], np.frombuffer(r["prints"], "<u4")) for r in table.filter(F.col("level") >= first).collect()]
    prints = np.concatenate([p for _, p in found]) if found else np.empty(0, np.uint32)
    levels = np.concatenate([np.full(len(p), x, np.uint8) for x, p in found]) if found else np.empty(0, np.uint8)
    order = np.argsort(prints, kind="stable")
    return prints[order], levels[order]
