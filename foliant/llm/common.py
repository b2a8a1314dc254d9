"""Shared parts of the corpus operators: text buffers, hashing, identities.

Texts travel between the JVM and Python as Arrow batches.  Everything here
works on the UTF-8 buffer of a whole slice of documents at once, so that the
cost per byte is a few NumPy passes and no Python loop runs per word.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy pass handles at a time (a longer document is one slice).
SLICE_BYTES = 1 << 18

_U = np.uint64
_LENGTH = 0x9E3779B97F4A7C15
_SHINGLE = 0xD1342543DE82EF95
#: Ranges up to this many bytes are hashed together in blocks of eight, longer ones one by one.
_TOGETHER = 64


def fmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


BYTE_VALUE = fmix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)], dtype=_U)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number (zeros beyond the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for arrays of bounds; equal bytes give equal hashes.

    Blocks of eight bytes are mixed one after another by a bijection, so ranges of up to
    eight bytes and one length never share a hash, and no pattern of longer ones does by rule.
    """
    size = (end - start).astype(np.int64)
    out = fmix(size.astype(_U) * _U(_LENGTH))
    which = np.flatnonzero((size > 0) & (size <= _TOGETHER))
    at, left, h, from_place = start[which], size[which], out[which], eights(data)
    while len(which):
        block = from_place[at]
        short = np.flatnonzero(left < 8)
        block[short] &= _LOW_BYTES[left[short]]
        h = fmix(h ^ block)
        more = left > 8
        out[which[~more]] = h[~more]
        which, at, left, h = which[more], at[more] + 8, left[more] - 8, h[more]
    for i in np.flatnonzero(size > _TOGETHER).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    bounds = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[bounds[0] : bounds[-1]] if bufs[2] is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about `most` bytes of text, or one document."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, bounds = utf8(batch.column(text))
        at = 0
        while at < n:
            to = int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words (runs without ASCII white space) of the documents of one buffer."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        n = len(data)
        data = LOWER[data] if lower else data
        self.data, self.bounds, self.docs = data, bounds, len(bounds) - 1
        inside = ~SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.inside = inside
        starts = inside & (first[:n] | ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        ends = inside & (first[1:] | ~after)
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: words before each document, and the document of each word
        self.before = np.searchsorted(self.start, bounds)
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.before))
        self.hash = range_hashes(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.before)


def window_hashes(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that begin a window of `size` words in one document, and its hash."""
    n = len(words.hash)
    if n < size:
        return np.empty(0, np.int64), np.empty(0, _U)
    total = np.zeros(n - size + 1, dtype=_U)
    for k in range(size):
        total += words.hash[k : n - size + 1 + k] * _U(pow(_SHINGLE, k + 1, 1 << 64))
    at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
    return at, fmix(total[at] + _U(size))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, ordered by document then hash.

    A document with 1 to size - 1 words has its whole sequence as one shingle.
    """
    at, h = window_hashes(words, size)
    doc = words.doc[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=_U)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += words.hash[words.before[short[has]] + k] * _U(pow(_SHINGLE, k + 1, 1 << 64))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, fmix(extra + counts[short].astype(_U))])
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session may leave it unset; it gets a folder of its own, as in tests.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/foliant-checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """End the lineage here: written to the shared folder, so a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that one partition of a table holds at least.
PACKED_ROWS = 1 << 15


def packed(df: DataFrame) -> DataFrame:
    """`cut` for narrow rows, read in no more partitions than they need.

    Each task of a later shuffle leaves some files, however few its rows; unions add up partitions.
    """
    held = cut(df)
    rows = held._jdf.queryExecution().toRdd()
    parts = max(1, -(-rows.count() // PACKED_ROWS))
    return held.coalesce(parts) if parts < rows.getNumPartitions() else held


#: Bytes of text for which a shuffle gets one partition at least.
PARTITION_BYTES = 64 << 20


def partitions(spark: SparkSession, size: int = 0) -> int:
    """Partitions of a shuffle that carries about as much as `size` bytes of text do: as set, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))


def text_bytes(numbered: DataFrame) -> int:
    """Bytes of all texts, counted."""
    return numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0


#: Rows of one key that one task may get in a join, and keys that are broadcast.
KEY_ROWS, BROADCAST_KEYS = 1 << 10, 1 << 20


def join_counted(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `table` (distinct keys; n: about how many rows have the key), whatever the skew.

    Keys with more than KEY_ROWS rows, or more than a BROADCAST_KEYS-th of all, are so few
    that they fit a broadcast; the others are joined by a shuffle.
    """
    total, top = table.agg(F.sum("n"), F.max("n")).first()
    most = max(KEY_ROWS, (total or 0) // BROADCAST_KEYS)
    if (top or 0) <= most:
        return rows.join(table.drop("n"), key, how)
    hot = table.filter(F.col("n") > most).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col("n") <= most).drop("n"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def by_position(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns renamed c0, c1, ..., and their own names, which may hold dots or clash."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns


def place_of(names: list[str], wanted: str) -> int:
    """The place of a column: by its very name, else whatever the case."""
    if wanted in names:
        return names.index(wanted)
    low = [n.lower() for n in names]
    if wanted.lower() not in low:
        raise ValueError(f"no column {wanted} among {names}")
    return low.index(wanted.lower())


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (string) and the columns `more`; others are dropped, whatever their names."""
    plain, names = by_position(docs)
    kinds = {"doc_id": "long", "text": "string"}
    return plain.select(*[(F.col(f"c{place_of(names, n)}").cast(kinds[n]) if n in kinds else F.col(f"c{place_of(names, n)}")).alias(n) for n in ("doc_id", "text", *more)])


def identified(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, bool]:
    """Columns uid, doc_id, text (with `whole` also c0, c1, ... for all columns by place), with a
    uid that is unique and never null; and whether uid is doc_id itself.

    It is where those are unique and present.  Otherwise (repeated rows, null ids) uid
    numbers the rows in order of doc_id, nulls last, then text; only doc_id is read to
    find out.
    """
    plain, names = by_position(docs)
    base = plain.select(F.col(f"c{place_of(names, 'doc_id')}").cast("long").alias("doc_id"), F.col(f"c{place_of(names, 'text')}").cast("string").alias("text"), *(plain.columns if whole else []))
    rest = base.columns[2:]
    odd = base.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return base.select(F.col("doc_id").alias("uid"), "doc_id", "text", *rest), True
    ordered = base.orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return cut(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", *rest)), False


def with_doc_ids(found: DataFrame, numbered: DataFrame, plain: bool) -> DataFrame:
    """`found` with uid replaced by the doc_id that it stands for."""
    if plain:
        return found.withColumnRenamed("uid", "doc_id")
    rest = [c for c in found.columns if c != "uid"]
    return found.join(numbered.select("uid", "doc_id"), "uid").select("doc_id", *rest)
