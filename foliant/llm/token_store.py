"""Token ids as sorted-string-table shards, and their reader.

A shard holds documents in ascending order of their key (the order-preserving eight
bytes of the identifier).  It is a row of blocks, then an index with the first key, place and
length of each block, a Bloom filter over the keys, and a footer of fixed size:

    block   zstd( entry* ), entry: shared, rest, value length (LEB128), rest of key, value
            (every block begins with a whole key; others share a prefix with the one before)
    index   entry count, then per block: key (8 bytes), offset, length (u64 each)
    bloom   number of bits (u64), number of probes (u64), the bits
    footer  index offset, bloom offset, documents, tokens, id width (u64 each), magic (8 bytes)

Values are little-endian ids, two bytes wide where the vocabulary allows, else four.

Shards are written by the tasks of a range-partitioned, sorted job, to a name that
the task's partition fixes, and put in place by a rename, so a task that runs again
leaves the same file.  They go to the folder that all executors share.

Defined cases: a null or empty text is its end id alone; where ids repeat or are null,
the rows are numbered in order of id (nulls last) and text, and those numbers are the
keys; an empty table makes no shard and an empty result.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import cut, identified, partitions, shared_folder, slices, with_doc_ids
from .tokens import encoder

MAGIC = b"FOLSST01"
FOOTER = struct.Struct("<QQQQQ8s")
BLOCK_BYTES, BLOOM_BITS_PER_KEY, BLOOM_PROBES = 64 << 10, 10, 7
#: Of keys divisible by this a read checks that a lookup (filter, index, block) gives what the scan gives.
LOOKED_UP = 50


def key_of(uid: int) -> bytes:
    """Eight bytes that sort as the signed number does."""
    return struct.pack(">Q", uid + (1 << 63))


def uid_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, count: int) -> list[int]:
    a = zlib.crc32(key)
    b = zlib.crc32(key, 0x9747B28C) | 1
    return [(a + i * b + i * i) % bits for i in range(count)]


class ShardWriter:
    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys = [], []
        self.at = self.tokens = 0

    def add(self, uid: int, ids: bytes) -> None:
        """ids: unsigned 32-bit."""
        key = key_of(uid)
        shared = len(os.path.commonprefix([key, self.last])) if self.block else 0
        if not self.block:
            self.first = key
        value = np.frombuffer(ids, "<u4")
        self.tokens += len(value)
        raw = value.astype("<u2").tobytes() if self.width == 2 else ids
        self.block += _varint(shared) + _varint(8 - shared) + _varint(len(raw)) + key[shared:] + raw
        self.keys.append(uid)
        self.last = key
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = self.pack(bytes(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        index = struct.pack("<Q", len(self.index)) + b"".join(k + struct.pack("<QQ", a, n) for k, a, n in self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        field = bytearray(bits // 8)
        for uid in self.keys:
            for p in _probes(key_of(uid), bits, BLOOM_PROBES):
                field[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<QQ", bits, BLOOM_PROBES) + bytes(field)
        self.out.write(index + bloom + FOOTER.pack(self.at, self.at + len(index), len(self.keys), self.tokens, self.width, MAGIC))


class ShardReader:
    """Reads a shard by parts: the footer, index and filter at first, then one block at a time."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = source.size()
        index_at, bloom_at, self.documents, self.tokens, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        rest = self._read(index_at, size - FOOTER.size - index_at)
        n = struct.unpack_from("<Q", rest)[0]
        self.index = [(rest[8 + 24 * i : 16 + 24 * i], *struct.unpack_from("<QQ", rest, 16 + 24 * i)) for i in range(n)]
        self.bits, self.probes = struct.unpack_from("<QQ", rest, bloom_at - index_at)
        self.field = rest[bloom_at - index_at + 16 :]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> Iterator[tuple[int, bytes]]:
        _, at, n = self.index[i]
        data, key, p = self.unpack(self._read(at, n)), b"", 0
        while p < len(data):
            shared, p = _read_varint(data, p)
            rest, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            value = data[p : p + size]
            p += size
            yield uid_of(key), np.frombuffer(value, "<u2").astype("<u4").tobytes() if self.width == 2 else value

    def scan(self) -> Iterator[tuple[int, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, uid: int) -> bytes | None:
        """The ids of one document: filter, binary search over the index, then one block."""
        key = key_of(uid)
        if not all(self.field[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.probes)):
            return None
        low, high = 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            if self.index[mid][0] <= key:
                low = mid + 1
            else:
                high = mid
        return next((ids for found, ids in self._block(low - 1) if found == uid), None) if low else None


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


MANIFEST = T.StructType([T.StructField("shard", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])


def write_store(numbered: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None) -> list[tuple]:
    """Write rows (uid, text) to shards; returns (shard, name, documents, tokens) in key order."""
    spark = numbered.sparkSession
    where, path = _files(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (fs, top) = encoder(vocabulary), _files(folder)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end, shard = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        draft, writer, out = f"{top}/{uuid.uuid4().hex}.tmp", None, None
        for part in slices(batches):
            if writer is None:
                out = fs.open_output_stream(draft)
                writer = ShardWriter(out, width)
            for uid, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                writer.add(uid, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            name = f"shard-{shard:08d}.sst"
            fs.move(draft, f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([name]), pa.array([len(writer.keys)]), pa.array([writer.tokens])], MANIFEST.names)

    ranged = numbered.select("uid", "text").repartitionByRange(shards or partitions(spark), "uid").sortWithinPartitions("uid")
    # One row for each shard, and shards have a fixed size: this is the store's own catalogue.
    return sorted(tuple(r) for r in ranged.mapInArrow(run, MANIFEST).collect())


def read_store(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """One row per document, read back from the shards: its key, place in the corpus, count and checksum."""
    rows, start = [], 0
    for shard, name, _, n_tokens in manifest:
        rows.append((shard, name, start, n_tokens))
        start += n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _files(folder)
        for batch in batches:
            for name, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with fs.open_input_file(f"{top}/{name}") as source:
                    found, reader = [], ShardReader(source)
                    for uid, ids in reader.scan():
                        if uid % LOOKED_UP == 0 and reader.get(uid) != ids:
                            raise ValueError(f"{name}: lookup of {uid} differs from the scan")
                        found.append((uid, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(found) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["uid", "start", "n_tokens", "ids_crc32"])
                            found = []
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["uid", "start", "n_tokens", "ids_crc32"])

    names = T.StructType([MANIFEST[0], MANIFEST[1], T.StructField("start", T.LongType()), MANIFEST[3]])
    listed = spark.createDataFrame(rows, names)
    listed = listed.repartition(max(1, min(len(rows), 4 * partitions(spark))))
    return listed.mapInArrow(run, "uid long, start long, n_tokens long, ids_crc32 long")


def store_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the store and read it back: doc_id, start, n_tokens, ids_crc32.  With `folder` the store stays there."""
    spark = docs.sparkSession
    numbered, plain = identified(docs)
    if folder:
        return with_doc_ids(read_store(spark, folder, write_store(numbered, folder, vocabulary, end_id)), numbered, plain)
    # A store of its own goes, with drafts of tasks that failed, when it has been read.
    folder = f"{shared_folder(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    try:
        found = cut(read_store(spark, folder, write_store(numbered, folder, vocabulary, end_id)))
    finally:
        where, path = _files(folder)
        where.delete_dir(path)
    return with_doc_ids(found, numbered, plain)
