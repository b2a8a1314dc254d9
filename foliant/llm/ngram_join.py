"""Exact Jaccard join of documents on word shingles by vertical partitioning.

1. Equal shingle sets make one class; only classes are joined.
2. A global order of shingles: rare first.  Frequencies are counted over all documents
   in fragments of the hash space; the most frequent ones (a bounded table) go to every
   task, the others count as equally rare and are ordered by hash.
3. Each class is cut along that order.  Its prefix of n - ceil(0.75 n) + 1 shingles, in
   which any partner must share one, is dealt to fragments of the hash space.  Each fragment
   pairs the classes that meet in a shingle, under the length and positional filters.
   Where many classes meet, they are paired with a few pivots only; the pairs that these
   leave open, between classes not yet in one component, follow in step 5.  A very frequent
   shingle is dealt in blocks of classes, and the blocks' pivots are paired.
4. A pair goes on if its sketches (counts of shingles by range of hashes), whose sum of least
   counts bounds the overlap, leave a link possible.  All shingles of these classes are dealt to
   fragments again: pairs to blocks by the least neighbour of their first class, so that those
   that hang together meet in one (in several, if there are very many), and within a block the order is cut in
   CUTS.  Each fragment counts partial overlaps for its cut of each pair, and a sum for each
   pair gives the whole overlap, which decides.
5. Pairs of classes that met among many, lie in different components, and pass the filters
   are verified in the same way, so that no link between components is missed.  The classes
   outside the largest component of such a group meet the others block by block.

A document's set: distinct windows of five words (A-Z lower-cased, ASCII white space);
with fewer words, the whole sequence as one.  Shingles are compared by 64-bit hashes.  Classes
have 64-bit names; where two different sets (told apart by 64 further bits) have one name,
both get another, so classes are the same in 128 bits or not at all.

Defined cases: null, empty and white-space texts have an empty set and link with nothing;
repeated rows link with each other; where ids repeat or are null, rows with one id share a
component id, the smallest id in their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, fmix, identified, join_counted, packed, partitions, shingles, slices, spread, text_bytes, utf8
from .deal import by_fragment, deal, fragment_of, fragments_of, gathered, undeal
from .frequent import frequent_prints
from .graph import components

#: Words in a shingle; links at 100 * intersection >= PERCENT * union.
SIZE, PERCENT = 5, 75
#: Frequencies under LEAST count as rare; shingles in 2**SPLIT documents are dealt in blocks of about as many classes.
LEAST, SPLIT = 32, 12
#: Classes that meet in a shingle are all paired up to CROWD; beyond, with the PIVOTS of least name (the same
#: ones wherever the group meets) and their neighbours at first, then, for those outside the main component, with
#: about MORE_PIVOTS, and at last all that are still apart, in blocks of BLOCK classes.
CROWD, PIVOTS, MORE_PIVOTS, BLOCK = 24, 2, (16, 128), 256
#: Shingles a task holds before it deals them out, and those that one fragment should verify.
HELD, FRAGMENT = 1 << 18, 1 << 19
#: Cuts of the order in which the overlaps of one block of pairs are counted, and pairs of one class in a block.
CUTS, PAIRS = 16, 1 << 14
#: Classes to be verified are looked up by a broadcast of at most this many bytes, beyond by a join.
BROADCAST_BYTES = 32 << 20
#: A sketch counts the shingles of a set in equal ranges of hashes, BUCKET to 2 * BUCKET in a range.
BUCKET = 4
#: Names of classes that a task remembers.
SEEN = 1 << 18

_U = np.uint64


def _signature(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, name and check of each document's set, whatever its order."""
    n = np.bincount(doc, minlength=docs).astype(np.int64)
    ends = np.cumsum(n)
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(fmix(h ^ _U(salt)))])
        out.append(fmix((sums[ends] - sums[ends - n]) ^ fmix(n.astype(_U) + _U(salt))))
    return n, out[0], out[1]


def _sets(batches: Iterator[pa.RecordBatch], clashes: np.ndarray, signature=_signature) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, document, shingle, size, name) of slice after slice."""
    for part in slices(batches):
        words = Words(*utf8(part.column(1)), lower=True)
        doc, h = shingles(words, SIZE)
        n, cid, check = signature(doc, h, words.docs)
        if len(clashes):
            cid = np.where(np.isin(cid, clashes), cid ^ check, cid)
        yield np.asarray(part.column(0)), doc, h, n, cid


def _sketches(n: np.ndarray, doc: np.ndarray, h: np.ndarray) -> pa.Array:
    """The sketch of each set: a byte for each of 2**k ranges (255: that many or more)."""
    bits = np.log2(np.maximum(n // BUCKET, 1)).astype(np.int64)
    size = np.int64(1) << bits
    ends = np.cumsum(size)
    place = (ends - size)[doc] + ((h >> _U(1)) >> (63 - bits[doc]).astype(_U)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=int(size.sum())), 255).astype(np.uint8)
    return pa.array([counts[a:b].tobytes() for a, b in zip((ends - size).tolist(), ends.tolist())], pa.binary())


def _most(x: bytes, y: bytes) -> int:
    """The most that two sets of these sketches can have in common."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    a, b = (np.where(v == 255, 1 << 40, v) for v in (a, b))
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(k, -1).sum(axis=1), b.reshape(k, -1).sum(axis=1)).sum())


def signatures(numbered: DataFrame) -> DataFrame:
    """uid, n, cid, check, sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(*utf8(part.column(1)), lower=True)
            doc, h = shingles(words, SIZE)
            n, cid, check = _signature(doc, h, words.docs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(cid.view(np.int64)), pa.array(check.view(np.int64)), _sketches(n, doc, h)], ["uid", "n", "cid", "check", "sketch"])

    return numbered.select("uid", "text").mapInArrow(run, "uid long, n long, cid long, check long, sketch binary")


def classified(numbered: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """uid, n, cid of every document; cid, rep (least uid), n (copies), sketch of every class that has a
    shingle; and the names that two different sets would have had."""
    signed = cut(signatures(numbered))

    def classes() -> DataFrame:
        grouped = signed.filter("n > 0").groupBy("cid")
        return cut(grouped.agg(F.min("uid").alias("rep"), F.count("*").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"), F.max("sketch").alias("sketch")))

    found = classes()
    # Names of 64 bits clash once in six thousand million classes, so there are a few at most.
    clashes = [r["cid"] for r in found.filter("low <> high").select("cid").collect()]
    if clashes:
        signed = signed.withColumn("cid", F.when(F.col("cid").isin(clashes), F.col("cid").bitwiseXOR(F.col("check"))).otherwise(F.col("cid")))
        found = classes()
    return signed.select("uid", "n", "cid"), found.select("cid", "rep", "n", "sketch"), np.array(clashes, dtype=np.int64).view(_U)


def _dealt(fragment: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    numbers, blobs = deal(fragment, columns)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["fragment", "blob"])


def frequent_shingles(numbered: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Prints of the most frequent shingles and their levels, counted over all documents."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, _, h, _, _ in _sets(batches, np.empty(0, _U), _signature):
            yield h

    return frequent_prints(numbered.select("uid", "text"), hashes, LEAST, size)


def _levels(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    prints, levels = frequent
    if not len(prints):
        return np.zeros(len(h), dtype=np.int64)
    mine = (h >> _U(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(prints, mine), len(prints) - 1)
    return np.where(prints[at] == mine, levels[at], 0).astype(np.int64)


def _prefix(n: np.ndarray) -> np.ndarray:
    """Shingles among which any partner shares one: n - ceil(PERCENT n / 100) + 1."""
    return n - -(-PERCENT * n // 100) + 1


def _need(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _fits(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Which pairs of sizes and places of a common shingle pass the length and positional filters."""
    left = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (left >= _need(na, nb))


def _all_pairs(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within runs given by their first index and size."""
    each = np.repeat(size, size) - 1 - spread(size)  # partners after each member
    first = np.repeat(at, size) + spread(size)
    a = np.repeat(first, each)
    return a, a + 1 + spread(each)


def _in_order(cid: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """a, b, na, nb of distinct pairs, the class of lesser name first (so a pivot comes first)."""
    swap = cid[a] > cid[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((cid[b], cid[a]))
    a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (cid[a][1:] != cid[a][:-1]) | (cid[b][1:] != cid[b][:-1])
    a, b = a[keep], b[keep]
    return cid[a].view(np.int64), cid[b].view(np.int64), n[a], n[b]


#: Low and high part of the shingle, name, size, place; of very frequent shingles the whole hash.
ENTRY, SPLIT_ENTRY = ["<u4", "u1", "<u8", "<u4", "<u2"], ["<u8", "<u8", "<u4", "<u2"]
FOUND = ["run", "a", "b", "na", "nb", "top"]


def candidates(numbered: DataFrame, frequent: tuple[np.ndarray, np.ndarray], clashes: np.ndarray, size: int) -> DataFrame:
    """Rows FOUND: pairs of classes (run null), and members a of crowded runs (b null, nb its place,
    top for the pivots of blocks of a very frequent shingle)."""
    spark = numbered.sparkSession
    parts = partitions(spark, size)
    fragments = fragments_of(parts, size)
    table = spark.sparkContext.broadcast(frequent)

    def group_of(h: np.ndarray, cid: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The shingle, or for a very frequent one the shingle and block of classes, as a hash."""
        blocks = _U(1) << np.maximum(level - SPLIT + 1, 0).astype(_U)
        return np.where(level >= SPLIT, fmix(h ^ fmix(cid & (blocks - _U(1)))), h)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, total = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            h, cid, n, place, level = (np.concatenate(c) for c in zip(*held))
            n, place = n.astype("<u4"), np.minimum(place, 65535).astype("<u2")
            hot = level >= SPLIT
            own = ~hot
            yield _dealt(fragment_of(h[own], fragments), [h[own].astype("<u4"), ((h[own] >> _U(32)) & _U(255)).astype("u1"), cid[own], n[own], place[own]])
            if hot.any():
                yield _dealt(fragments + fragment_of(group_of(h[hot], cid[hot], level[hot]), fragments), [h[hot], cid[hot], n[hot], place[hot]])

        for _, doc, h, n, cid in _sets(batches, clashes, _signature):
            if len(seen) > SEEN:
                seen.clear()
            new = np.array([c not in seen and not seen.add(c) for c in cid.tolist()], dtype=bool)
            level = _levels(h, table.value)
            order = np.argsort(doc * 64 + level, kind="stable")
            doc, h, level = doc[order], h[order], level[order]
            place = spread(n)
            chosen = (place < _prefix(n)[doc]) & new[doc]
            held.append((h[chosen], cid[doc[chosen]], n[doc[chosen]], place[chosen], level[chosen]))
            total += int(chosen.sum())
            if total >= HELD:
                yield from out()
                held, total = [], 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, blobs in by_fragment(batches):
            if fragment < fragments:
                low, high, cid, n, place = undeal(blobs, ENTRY)
                h = low.astype(_U) | high.astype(_U) << _U(32)
                group, key = h, h | _U(fragment) << _U(40)
            else:
                h, cid, n, place = undeal(blobs, SPLIT_ENTRY)
                group, key = group_of(h, cid, _levels(h, table.value)), fmix(h)
            order = np.lexsort((cid, group))
            group, key, cid, n, place = group[order], key[order], cid[order], n[order].astype(np.int64), place[order].astype(np.int64)
            new = np.ones(len(group), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (cid[1:] != cid[:-1])
            group, key, cid, n, place = group[new], key[new], cid[new], n[new], place[new]
            at = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
            size = np.diff(np.append(at, len(group)))
            crowded = (size > CROWD) | (fragment >= fragments)
            some = (size > 1) & ~crowded
            a, b = _all_pairs(at[some], size[some])
            if crowded.any():
                first, count = at[crowded], size[crowded]
                member, inner = np.repeat(first, count) + spread(count), spread(count)
                for k in range(PIVOTS):
                    pivot = np.repeat(first + np.minimum(k, count - 1), count)
                    a, b = np.append(a, pivot), np.append(b, member)
                a, b = np.append(a, member[inner > 0] - 1), np.append(b, member[inner > 0])
                top = (inner < PIVOTS) if fragment >= fragments else np.zeros(len(member), dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[member].view(np.int64), cid[member].view(np.int64))] + [pa.nulls(len(member), pa.int64())] + [pa.array(x) for x in (n[member], place[member], top)], FOUND)
            good = _fits(n[a], place[a], n[b], place[b]) & (a != b)
            pairs = _in_order(cid, n, a[good], b[good])
            if len(pairs[0]):
                nothing = len(pairs[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(nothing, pa.int64()), *(pa.array(x) for x in pairs), pa.nulls(nothing, pa.bool_())], FOUND)

    dealt = numbered.select("uid", "text").mapInArrow(send, "fragment long, blob binary")
    return gathered(dealt, parts).mapInArrow(meet, "run long, a long, b long, na long, nb long, top boolean")


def _unsigned(c: str) -> Column:
    """A long that sorts as the name's 64 bits do without a sign."""
    return F.col(c).bitwiseXOR(F.lit(-(2**63)))


def pivots_of_blocks(members: DataFrame) -> DataFrame:
    """a, b, na, nb: the pivots of the blocks of each very frequent shingle with the least of them."""
    tops = members.filter("top").select("run", _unsigned("a").alias("u"), "a", "na", "nb")
    lead = tops.groupBy("run").agg(F.min(F.struct("u", "a", "na", "nb")).alias("least"))
    both = tops.withColumnsRenamed({"a": "b", "na": "n", "nb": "place"}).join(lead, "run").filter(F.col("b") != F.col("least.a"))
    a, n, at = F.col("least.a"), F.col("least.na"), F.col("least.nb")
    left = 1 + F.least(n - at - 1, F.col("n") - F.col("place") - 1)
    fits = (100 * F.least(n, F.col("n")) >= PERCENT * F.greatest(n, F.col("n"))) & (left * (100 + PERCENT) >= PERCENT * (n + F.col("n")))
    return both.filter(fits).select(a.alias("a"), "b", n.alias("na"), F.col("n").alias("nb"))


def possible(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b, na, nb) of classes those whose sketches leave a link possible, as uids a, b of
    their first documents; name: the first class's, in order."""
    # From names to first documents.  A pivot may have very many pairs; another class comes second to few.
    degree = packed(pairs.groupBy("a").agg(F.count("*").alias("n")))
    first = classes.select(F.col("cid").alias("a"), F.col("rep").alias("ra"), F.col("sketch").alias("sa")).join(degree, "a")
    second = classes.select(F.col("cid").alias("b"), F.col("rep").alias("rb"), F.col("sketch").alias("sb"))
    both = join_counted(pairs, first, "a").join(second, "b").select("ra", "rb", "na", "nb", _unsigned("a").alias("name"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.array([_most(x, y) for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())], dtype=np.int64)
            near = most >= _need(np.asarray(batch.column(2)), np.asarray(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in range(5)], ["a", "b", "na", "nb", "name"])

    return both.mapInArrow(run, "a long, b long, na long, nb long, name long")


def verified(numbered: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b, na, nb) of classes those whose whole overlap links them, as uids a, b of their first documents."""
    spark = numbered.sparkSession
    named = packed(possible(classes, pairs))
    count, total = named.select(F.col("a").alias("uid"), F.col("na").alias("n")).union(named.select("b", "nb")).distinct().agg(F.count("*"), F.sum("n")).first()
    if not count:
        return named.select("a", "b").limit(0)
    # Pairs that hang together share a block: that of the first class's least neighbour.  Very many of one such
    # class take as many blocks as they need; a set goes to the blocks of its pairs.
    blocks = -(-total // (CUTS * FRAGMENT))
    lead = named.groupBy(F.col("b").alias("a")).agg(F.min("name").alias("least"))
    heads = named.groupBy("a").agg(F.count("*").alias("n"), F.min("name").alias("own")).join(lead, "a", "left")
    led = packed(join_counted(named, heads.select("a", "n", F.coalesce("least", "own").alias("lead")), "a"))
    of = led.groupBy("lead").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), "parts")).otherwise(0)
    block = F.pmod(F.pmod(F.xxhash64("lead"), F.lit(1 << 40)) + part, F.lit(blocks)).cast("long")
    placed = packed(join_counted(led, of, "lead").select("a", "b", "na", "nb", block.alias("block")))
    nodes = placed.select(F.col("a").alias("uid"), "block").union(placed.select("b", "block")).distinct()
    wanted = packed(nodes.groupBy("uid").agg(F.collect_set("block").alias("blocks")))
    places = wanted.agg(F.sum(F.size("blocks"))).first()[0]
    small = 64 * count + 8 * places <= BROADCAST_BYTES
    chosen = numbered.select("uid", "text").join(F.broadcast(wanted) if small else wanted, "uid")
    parts = max(partitions(spark), -(-places * total // (count * 2 * FRAGMENT)))

    def cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            fragment, uid, h = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((uid, fragment))
            fragment, uid, h = fragment[order], uid[order], h[order].astype("<u8")
            # A fragment gets each document's id once, with the number of its shingles.
            first = np.flatnonzero(np.append(True, (fragment[1:] != fragment[:-1]) | (uid[1:] != uid[:-1])))
            size = np.diff(np.append(first, len(h))).astype("<u4")
            at = np.flatnonzero(np.append(True, fragment[first][1:] != fragment[first][:-1]))
            ends, blobs = np.append(at[1:], len(first)), []
            for a, e in zip(at.tolist(), ends.tolist()):
                low, high = int(first[a]), int(first[e]) if e < len(first) else len(h)
                blobs.append(np.array([e - a], "<u4").tobytes() + uid[first[a:e]].astype("<i8").tobytes() + size[a:e].tobytes() + h[low:high].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(fragment[first[at]], pa.int64()), pa.array(blobs, pa.binary()), pa.array([True] * len(blobs))], ["fragment", "blob", "is_set"])

        for part in slices(batches):
            doc, h = shingles(Words(*utf8(part.column(1)), lower=True), SIZE)
            flat, size = np.asarray(part.column(2).flatten()), np.asarray(pc.list_value_length(part.column(2))).astype(np.int64)
            each = size[doc]
            entry = np.repeat(np.arange(len(h)), each)
            block = flat[np.repeat((np.cumsum(size) - size)[doc], each) + spread(each)]
            held.append((block * CUTS + fragment_of(h, CUTS)[entry], np.asarray(part.column(0))[doc[entry]], h[entry]))
            total += len(entry)
            if total >= HELD:
                yield out()
                held, total = [], 0
        if total:
            yield out()

    def cut_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb, block = (np.asarray(batch.column(i)).astype("<i8") for i in range(5))
                numbers, blobs = deal(block, [a, b, (na + nb).astype("<u4")])
                fragment = [x * CUTS + k for x in numbers for k in range(CUTS)]
                yield pa.RecordBatch.from_arrays([pa.array(fragment, pa.int64()), pa.array([x for x in blobs for _ in range(CUTS)], pa.binary()), pa.array([False] * len(fragment))], ["fragment", "blob", "is_set"])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """(sets, pairs) of each fragment, one at a time."""
        at, sets, asked = None, [], []
        for batch in batches:
            for fragment, data, is_set in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if fragment != at:
                    if sets and asked:
                        yield sets, asked
                    at, sets, asked = fragment, [], []
                (sets if is_set else asked).append(data.as_py())
        if sets and asked:
            yield sets, asked

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets, asked in fragments(batches):
            uids, sizes, hashes = [], [], []
            for data in sets:
                n = int(np.frombuffer(data, "<u4", 1)[0])
                uids.append(np.frombuffer(data, "<i8", n, 4))
                sizes.append(np.frombuffer(data, "<u4", n, 4 + 8 * n))
                hashes.append(np.frombuffer(data, "<u8", -1, 4 + 12 * n))
            ids, size, h = np.concatenate(uids), np.concatenate(sizes).astype(np.int64), np.concatenate(hashes)
            order = np.argsort(ids, kind="stable")
            begin = np.cumsum(size) - size
            h = h[np.repeat(begin[order], size[order]) + spread(size[order])]
            ids, size = ids[order], size[order]
            begin = np.cumsum(size) - size
            a, b, total = undeal(asked, ["<i8", "<i8", "<u4"])
            kinds, which = np.unique(h, return_inverse=True)
            # Shingles of a document in order, documents in order: one sorted list of (document, shingle).
            key = np.sort(np.repeat(np.arange(len(ids)), size) * len(kinds) + which)
            i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
            here = (i < len(ids)) & (j < len(ids))
            here[here] = (ids[i[here]] == a[here]) & (ids[j[here]] == b[here])
            a, b, total, i, j = a[here], b[here], total[here], i[here], j[here]
            small = size[i] > size[j]
            i, j = np.where(small, j, i), np.where(small, i, j)
            step = max(1, (1 << 20) // max(1, int(size.max())))
            for at in range(0, len(a), step):
                x, y = i[at : at + step], j[at : at + step]
                n = size[x]
                member = np.repeat(begin[x], n) + spread(n)
                probe = np.repeat((y - x) * len(kinds), n) + key[member]
                spot = np.minimum(np.searchsorted(key, probe), len(key) - 1)
                sums = np.concatenate([[0], np.cumsum(key[spot] == probe)])
                ends = np.cumsum(n)
                partial = sums[ends] - sums[ends - n]
                some = np.flatnonzero(partial > 0) + at
                pair = fmix(a[some].view(_U) ^ fmix(b[some].view(_U)))
                yield _dealt(fragment_of(pair, 4 * parts), [a[some], b[some], total[some], partial[partial > 0].astype("<u4")])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in by_fragment(batches):
            a, b, total, partial = undeal(blobs, ["<i8", "<i8", "<u4", "<u4"])
            order = np.lexsort((b, a))
            a, b, total, partial = a[order], b[order], total[order].astype(np.int64), partial[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            common = np.add.reduceat(partial, first)
            linked = first[100 * common >= PERCENT * (total[first] - common)]
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], ["a", "b"])

    schema = "fragment long, blob binary, is_set boolean"
    cuts = chosen.mapInArrow(cut_sets, schema).unionByName(placed.mapInArrow(cut_pairs, schema))
    partial = gathered(cuts, parts).mapInArrow(overlaps, "fragment long, blob binary")
    return gathered(partial, parts).mapInArrow(whole, "a long, b long")


def open_pairs(members: DataFrame, labels: DataFrame, first: int | None) -> DataFrame | None:
    """Pairs of classes that met in a crowd, pass the filters, and are in different components
    (labels: a, label of all classes); none if each crowd lies in one component.

    With `first`, only those of a class outside its crowd's main component with about `first`
    classes of least name; else all.  The classes outside are dealt in blocks, and the others
    to each of these in blocks, so no task holds a crowd.
    """
    spark = members.sparkSession
    known = packed(members.select("run", "a", "na", "nb").join(labels, "a"))
    sizes = known.groupBy("run", "label").agg(F.count("*").alias("n"))
    runs = sizes.groupBy("run").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("total"), F.count("*").alias("kinds"))
    runs = packed(runs.filter("kinds > 1").select("run", "main", "total", F.ceil(F.col("inside") / BLOCK).cast("long").alias("km"), F.ceil((F.col("total") - F.col("inside")) / BLOCK).cast("long").alias("ko")))
    n_runs = runs.count()
    if not n_runs:
        return None
    rows = known.join(F.broadcast(runs) if 64 * n_runs <= BROADCAST_BYTES else runs, "run")
    rows = rows.withColumn("outside", F.col("label") != F.col("main")).withColumn("own", F.pmod(F.xxhash64("a"), F.when(F.col("outside"), F.col("ko")).otherwise(F.col("km"))))
    every = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"))
    one, last = F.lit(0).cast("long"), F.col("ko") - 1
    if first is None:
        # Blocks outside meet each other (i <= j < ko), themselves, and the blocks inside (ko + block).
        outside = F.concat(
            F.transform(every(F.col("own"), F.col("ko") + F.col("km") - 1), lambda j: place(F.col("own"), j, True)),
            F.transform(every(one, F.col("own") - 1), lambda i: place(i, F.col("own"), False)),
        )
        to = F.when(F.col("outside"), outside).otherwise(F.transform(every(one, last), lambda i: place(i, F.col("ko") + F.col("own"), False)))
    else:
        pivot = _unsigned("a") < F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), first / F.col("total"))
        nowhere = F.array().cast("array<struct<i:long,j:long,left:boolean>>")
        to = F.concat(
            F.when(F.col("outside"), F.array(place(F.col("own"), F.lit(-1).cast("long"), True))).otherwise(nowhere),
            F.when(pivot, F.transform(every(one, last), lambda i: place(i, F.lit(-1).cast("long"), False))).otherwise(nowhere),
        )
    rows = rows.select("run", F.explode(to).alias("to"), "a", "na", "nb", "label").select("run", "to.i", "to.j", "to.left", "a", "na", "nb", "label")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) if k != 3 else np.asarray(batch.column(k).to_pylist(), dtype=bool) for k in range(8)]
            if held:
                columns = [np.concatenate([x, y]) for x, y in zip(held[0], columns)]
            key = columns[:3]
            new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
            at = np.flatnonzero(new).tolist()
            for x, y in zip(at, at[1:]):
                yield [c[x:y] for c in columns]
            held = [[c[at[-1] :] for c in columns]]
        if held:
            yield held[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, left, a, n, place_, label in groups(batches):
            cid, mine = a.view(_U), np.flatnonzero(left)
            other = mine if i[0] == j[0] else np.flatnonzero(~left)
            step = max(1, (1 << 20) // max(1, len(other)))
            for low in range(0, len(mine), step):
                some = mine[low : low + step]
                x, y = np.repeat(some, len(other)), np.tile(other, len(some))
                good = label[x] != label[y]
                x, y = x[good], y[good]
                good = _fits(n[x], place_[x], n[y], place_[y])
                pairs = _in_order(cid, n, x[good], y[good])
                if len(pairs[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], ["a", "b", "na", "nb"])

    dealt = rows.repartition(partitions(spark), "run", "i", "j").sortWithinPartitions("run", "i", "j")
    return dealt.mapInArrow(run, "a long, b long, na long, nb long").distinct()


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """cid, rep, n, label of every class: the smallest first document that links lead to."""
    found = components(links).withColumnRenamed("node", "rep")
    return packed(classes.join(found, "rep", "left").select("cid", "rep", "n", F.coalesce("label", "rep").alias("label")))


def _first_pairs(numbered: DataFrame, clashes: np.ndarray, size: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b, na, nb to be verified first, and members of crowds."""
    found = packed(candidates(numbered, frequent_shingles(numbered, size), clashes, size))
    pairs, members = found.filter("run is null").select("a", "b", "na", "nb"), found.filter("run is not null")
    if members.filter("top").limit(1).count():
        pairs = pairs.unionByName(pivots_of_blocks(members))
    return packed(pairs.distinct()), members


def join_components(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """(numbered documents, with `whole` all their columns; uid, n_shingles, component by uid; whether uid is doc_id)."""
    numbered, plain = identified(docs, whole)
    size = text_bytes(numbered)
    signed, classes, clashes = classified(numbered)
    pairs, members = _first_pairs(numbered, clashes, size)
    links = packed(verified(numbered, classes, pairs))
    labels = _labels(classes, links)
    if members.limit(1).count():
        known = pairs.select("a", "b")
        for first in (*MORE_PIVOTS, None):
            more = open_pairs(members, labels.select(F.col("cid").alias("a"), "label"), first)
            if more is None:
                break
            more = packed(more.join(known, ["a", "b"], "left_anti"))
            if more.limit(1).count():
                links = packed(links.unionByName(verified(numbered, classes, more)))
                known = known.unionByName(more.select("a", "b"))
                labels = _labels(classes, links)
    special = labels.filter("n > 1 or label <> rep").select("cid", "label", "n")
    result = join_counted(signed.withColumnRenamed("n", "n_shingles"), special, "cid", "left")
    return numbered, result.select("uid", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "uid")).otherwise(F.col("uid")).alias("component")), plain


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id reachable by links."""
    numbered, found, plain = join_components(docs)
    if plain:
        return found.select(F.col("uid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    ids = numbered.select("uid", "doc_id")
    first = ids.select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id"))
    return found.join(ids, "uid").join(first, "component").select("doc_id", "n_shingles", "component_id")


def similar_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The join itself: (uid a, uid b of the first documents of all linked classes of different sets;
    uid, doc_id, first: every document with a shingle and the first one of its class).

    Every pair that meets and passes the filters is verified here, in crowds as well.
    """
    numbered, _ = identified(docs)
    size = text_bytes(numbered)
    signed, classes, clashes = classified(numbered)
    pairs, members = _first_pairs(numbered, clashes, size)
    more = open_pairs(members, classes.select(F.col("cid").alias("a"), F.col("rep").alias("label")), None)
    if more is not None:
        pairs = packed(pairs.unionByName(more).distinct())
    of = join_counted(signed.filter("n > 0").select("uid", "cid"), classes.select("cid", "n", F.col("rep").alias("first")), "cid")
    return verified(numbered, classes, pairs), numbered.select("uid", "doc_id").join(of.select("uid", "first"), "uid")


def link_counts(docs: DataFrame) -> DataFrame:
    """uid, doc_id, n_links: how many other documents each document with a shingle links with."""
    pairs, members = similar_pairs(docs)
    members = packed(members)
    size = packed(members.groupBy("first").agg(F.count("*").alias("n")))
    ends = pairs.select(F.col("a").alias("first"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    linked = ends.join(size.withColumnsRenamed({"first": "other", "n": "copies"}), "other").groupBy("first").agg(F.sum("copies").alias("others"))
    each = size.join(linked, "first", "left").select("first", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return join_counted(members, each, "first").select("uid", "doc_id", "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns."""
    numbered, found, _ = join_components(docs, whole=True)
    others = packed(found.filter("component <> uid").select("uid"))
    gone = F.broadcast(others) if 24 * others.count() <= BROADCAST_BYTES else others
    kept = numbered.join(gone, "uid", "left_anti")
    return kept.select(*[F.col(f"c{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
