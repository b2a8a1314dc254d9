"""Entries dealt to fragments as bytes: many small records in few rows.

Tasks hold the records of a few megabytes of text, keep what they can decide themselves
(of equal keys only the first record can matter elsewhere), and send each fragment of the
key space one row with its records, column after column.  Spark sorts the rows of a partition
by fragment, so a task of the next stage holds the records of one fragment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blob(columns: list[np.ndarray]) -> bytes:
    return np.array([len(columns[0])], "<u4").tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def deal(fragment: np.ndarray, columns: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    """Fragment numbers that occur, and their records as bytes."""
    order = np.argsort(fragment, kind="stable")
    fragment, columns = fragment[order], [c[order] for c in columns]
    at = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])) if len(fragment) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(fragment))
    return fragment[at].tolist(), [blob([c[a:e] for c in columns]) for a, e in zip(at.tolist(), ends.tolist())]


def undeal(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for data in blobs:
        n, at = int(np.frombuffer(data, "<u4", 1)[0]), 4
        for column, kind in zip(out, kinds):
            column.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.empty(0, k) for c, k in zip(out, kinds)]


#: Bytes of text whose records one fragment gets.
FRAGMENT_BYTES = 16 << 20

#: Rows dealt to fragments; with a uid the blob is about that document and only passes through.
DEALT = "fragment long, blob binary, uid long"


def fragments_of(parts: int, size: int) -> int:
    """Fragments for the records of `size` bytes of text in `parts` partitions."""
    return max(4 * parts, -(-size // FRAGMENT_BYTES))


def gathered(dealt: DataFrame, parts: int) -> DataFrame:
    """Rows of one fragment side by side in one partition, sorted by Spark, which can spill; as many fragments in each."""
    return dealt.repartitionById(parts, F.pmod("fragment", F.lit(parts)).cast("int")).sortWithinPartitions("fragment")


def dealt_rows(fragment: list[int], blobs: list[bytes], uids: list[int] = [], told: list[bytes] = [], fragments: int = 1) -> pa.RecordBatch:  # noqa: B006
    """Rows of the kind DEALT: blobs for fragments, and what is known already about documents."""
    return pa.RecordBatch.from_arrays(
        [pa.array(fragment + [u % fragments for u in uids], pa.int64()), pa.array(blobs + told, pa.binary()), pa.array([None] * len(fragment) + uids, pa.int64())], ["fragment", "blob", "uid"]
    )


def by_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]] | tuple[None, pa.RecordBatch]]:
    """Each fragment of gathered rows with its blobs, one fragment in memory at a time.

    Rows about documents come as (None, batch of the kind ABOUT) as soon as they are read.
    """
    at, held = None, []
    for batch in batches:
        if batch.num_columns > 2:
            told = batch.column(2).is_valid()
            some = batch.filter(told)
            if some.num_rows:
                yield None, pa.RecordBatch.from_arrays([some.column(2), some.column(1)], ["uid", "records"])
                batch = batch.filter(pc.invert(told))
        for fragment, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if fragment != at:
                if held:
                    yield at, held
                at, held = fragment, []
            held.append(data.as_py())
    if held:
        yield at, held


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are equal ranges of 64-bit hashes."""
    return (((h >> np.uint64(40)) * np.uint64(fragments)) >> np.uint64(24)).astype(np.int64)


#: Rows about documents: uid, and records of that document.
ABOUT = "uid long, records binary"


def about(uid: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each document that occurs, with its records."""
    uids, blobs = deal(uid, columns)
    return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(blobs, pa.binary())], ["uid", "records"])


def with_records(numbered: DataFrame, records: DataFrame) -> DataFrame:
    """uid, doc_id, text and the list of all records about each document (null: none)."""
    each = records.groupBy("uid").agg(F.collect_list("records").alias("records"))
    return numbered.select("uid", "doc_id", "text").join(each, "uid", "left")


def spans_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal runs, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]
