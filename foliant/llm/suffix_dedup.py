"""Exact substring dedup: suffixes sorted shallow and deep, in buckets that hold all equals.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in order of
document, then place).  Every such string holds one anchor: of its substrings of ANCHOR
bytes the one with the least hash, leftmost.  Equal strings have equal anchors, so the
strings fall into buckets by anchor that can be sorted apart:

1. The piece of text that holds all strings of an anchor is named to the anchor's fragment.
   An anchor that stands in one piece only needs no more work.  The strings around a very
   frequent anchor (a bounded table, see `frequent`) are named one by one, by hashes of
   their own, so that an anchor that is in every document doesn't make one task's work.
   This is a filter: it says what has to be compared, and never that anything repeats.
2. What has to be compared is sent as bytes.  A task sends equal pieces once.
3. In each bucket of the fragment, the strings that begin at each place of its different
   pieces are sorted deep-shallow: by a multikey quicksort with ternary partition over words
   of eight bytes down to SHALLOW bytes, then a blind trie for each group that is still
   equal.  Of equal strings all but the earliest are repeats.  A bucket with one kind of
   piece has no two equal strings to order; all but the earliest place of the piece repeat.

Nothing is taken out on a hash: pieces and strings that repeat were equal byte for byte.
A long text is cut into segments that overlap by a string, so memory doesn't grow with it.

Defined cases: null and empty texts, and those under LENGTH bytes, lose nothing; repeated
rows and null ids: rows are taken in order of id (nulls last) and text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, eights, fmix, identified, partitions, range_hashes, slices, spread, text_bytes, utf8
from .deal import ABOUT, DEALT, about, blob, by_fragment, deal, dealt_rows, fragment_of, fragments_of, gathered, spans_of, undeal, with_records
from .frequent import frequent_prints

#: ANCHOR and SHALLOW are whole words of eight bytes.
LENGTH, ANCHOR, SHALLOW = 100, 24, 32
#: Anchors this frequent have their strings dealt one by one.
CROWD = 2048
#: Strings that a task holds before it names them, bytes before it sends them, and bytes of one segment.
HELD, HELD_BYTES, SEGMENT = 1 << 19, 12 << 20, SLICE_BYTES
#: Parts that the quicksort leaves to a plain sort.
SMALL = 24

_U = np.uint64


class Pieces:
    """Runs of neighbouring strings with one anchor: hash, first start, number of strings, document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data = data
        found = [self._segment(data, bounds, at, min(len(data), at + SEGMENT + LENGTH - 1)) for at in range(0, max(1, len(data)), SEGMENT)]
        self.hash, self.first, self.count, self.doc = (np.concatenate(c) for c in zip(*found))

    @staticmethod
    def _segment(data: np.ndarray, bounds: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        n, reach, empty = high - low, LENGTH - ANCHOR + 1, np.empty(0, np.int64)
        if n < LENGTH:
            return np.empty(0, _U), empty, empty, empty
        words, m = eights(data[low:high]), n - ANCHOR + 1
        h = words[:m] * _U(0x9E3779B97F4A7C15)
        h += words[8 : m + 8] * _U(0xC2B2AE3D27D4EB4F)
        h += words[16 : m + 16] * _U(0x165667B19E3779F9)
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        # Upper half by hash, lower half by place: of equal ones the leftmost is the least.
        least = h & _U(0xFFFFFFFF00000000)
        least |= np.arange(m, dtype=_U)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        at = (least & _U(0xFFFFFFFF)).astype(np.int64)
        # Strings that lie in one document.
        inner = np.clip(bounds, low, high) - low
        whole = np.zeros(len(at), dtype=bool)
        doc = np.zeros(len(at), dtype=np.int64)
        for d in range(int(np.searchsorted(bounds, low, "right")) - 1, int(np.searchsorted(bounds, high, "left"))):
            a, b = int(inner[d]), min(len(at), int(inner[d + 1]) - LENGTH + 1)
            if b > a:
                whole[a:b], doc[a:b] = True, d
        new = whole.copy()
        new[1:] &= (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new)
        ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True)) + 1
        # Least hashes crowd at the low end; mixed again, they spread over the fragments.
        return fmix(h[at[first]] ^ _U(0xA0761D6478BD642F)), first + low, ends - first, doc[first]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number (zeros beyond the end)."""
    return eights(data)[: len(data)].astype("<u8").byteswap()


class BlindTrie:
    """Strings of one length, kept by the places where they part; whole strings are compared once each."""

    def __init__(self, first: bytes, member: int):
        self.size = len(first)
        self.root: list = [self.size, None, first, [member]]  # place of parting, branches, a string below, its members

    def add(self, text: bytes, member: int) -> None:
        node, path = self.root, []
        while node[1] is not None:  # blindly: only the bytes where strings part are looked at
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[2]
        if other == text:
            node[3].append(member)
            return
        difference = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        common = self.size - (difference.bit_length() + 7) // 8
        at, parent = self.root, None
        for step in path:  # the first node that parts no earlier than the two strings do
            if step[0] >= common:
                break
            parent, at = step, step[1][text[step[0]]]
        leaf = [self.size, None, text, [member]]
        if at[1] is not None and at[0] == common:
            at[1][text[common]] = leaf
            return
        branch = [common, {text[common]: leaf, at[2][common]: at}, at[2], None]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        """Strings in order, with their members."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[1] is None:
                yield node[2], node[3]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def multikey_quicksort(words: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their buckets (equal neighbours in `bucket`) by `depth` words
    of eight bytes, and whether each begins a group of its own.

    Every part is split three ways by the word at its own depth: less than, equal to and
    greater than the median of its first, middle and last string; the equal strings go one
    word deeper.  All parts of one round are split in the same array passes, and parts of at
    most SMALL strings are left to a plain sort.
    """
    n = len(start)
    order, none = np.arange(n), np.empty(0, np.int64)
    low = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else none
    size, level, small = np.diff(np.append(low, n)), np.zeros(len(low), dtype=np.int64), [(none, none)]
    while True:
        left = (size > 1) & (size <= SMALL)
        small.append((low[left], size[left]))
        big = size > SMALL
        low, size, level = low[big], size[big], level[big]
        if not len(low):
            break
        place = np.repeat(low, size) + spread(size)
        part = np.repeat(np.arange(len(low)), size)
        key = words[start[order[place]] + 8 * level[part]]
        begin = np.cumsum(size) - size
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
        side = (key > pivot).astype(np.int64) + (key >= pivot)
        count = np.bincount(3 * part + side, minlength=3 * len(low)).reshape(-1, 3)
        to = np.empty(len(place), dtype=np.int64)
        for k in range(3):
            mine = side == k
            rank = np.cumsum(mine) - mine
            to[mine] = (low + count[:, :k].sum(axis=1) - rank[begin])[part[mine]] + rank[mine]
        order[to] = order[place]
        low = (low[:, None] + np.cumsum(count, axis=1) - count).ravel()
        size, level = count.ravel(), (level[:, None] + np.array([0, 1, 0])).ravel()
        more = level < depth
        low, size, level = low[more], size[more], level[more]
    low, size = (np.concatenate(c) for c in zip(*small))
    sort = np.argsort(low)
    low, size = low[sort], size[sort]
    place = np.repeat(low, size) + spread(size)
    mine = order[place]
    keys = [words[start[mine] + 8 * k] for k in range(depth)]
    order[place] = mine[np.lexsort((*keys[::-1], np.repeat(low, size)))]
    new = np.ones(n, dtype=bool)
    new[1:] = bucket[order][1:] != bucket[order][:-1]
    for k in range(depth):
        key = words[start[order] + 8 * k]
        new[1:] |= key[1:] != key[:-1]
    return order, new


def deep_shallow(data: np.ndarray, start: np.ndarray, bucket: np.ndarray | None = None, size: int = LENGTH, shallow: int = SHALLOW) -> Iterator[list[int]]:
    """Groups of two and more equal strings data[s:s + size] (indices into start), in sorted order within each bucket."""
    order, new = multikey_quicksort(_words(data), start, np.zeros(len(start), np.int64) if bucket is None else bucket, shallow // 8)
    at = np.flatnonzero(new)
    width = np.diff(np.append(at, len(order)))
    several = width > 1
    raw, starts, order = data.tobytes(), start.tolist(), order.tolist()
    for a, n in zip(at[several].tolist(), width[several].tolist()):
        group = order[a : a + n]
        first = starts[group[0]]
        trie = BlindTrie(raw[first + shallow : first + size], group[0])
        for i in group[1:]:
            s = starts[i]
            trie.add(raw[s + shallow : s + size], i)
        for _, members in trie.leaves():
            if len(members) > 1:
                yield members


def _among(h: np.ndarray, prints: np.ndarray) -> np.ndarray:
    if not len(prints):
        return np.zeros(len(h), dtype=bool)
    mine = (h >> _U(32)).astype(np.uint32)
    return prints[np.minimum(np.searchsorted(prints, mine), len(prints) - 1)] == mine


def _strings(pieces: Pieces, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, document and own hash of each string of the crowded pieces."""
    n = pieces.count[crowded]
    one = np.repeat(pieces.first[crowded], n) + spread(n)
    words, h = eights(pieces.data), np.zeros(len(one), dtype=_U)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = fmix(h ^ words[one + k])
    return one, np.repeat(pieces.doc[crowded], n), h


def compared(numbered: DataFrame, crowd: tuple[np.ndarray, np.ndarray], parts: int, fragments: int) -> DataFrame:
    """For each document the starts of its pieces whose anchor stands in other pieces too, and of its
    strings around very frequent anchors that share their hash with others."""
    table = numbered.sparkSession.sparkContext.broadcast(crowd[0])
    kinds = ["<u4", "u1", "<i8", "<u4", "u1"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def out() -> pa.RecordBatch:
            h, uid, first = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, uid, first = h[order], uid[order], first[order].astype("<u4")
            again = np.append(False, h[1:] == h[:-1])
            shared = np.append(again[1:], False)[~again]
            one = h[~again]
            columns = [one.astype("<u4"), ((one >> _U(32)) & _U(255)).astype("u1"), uid[~again].astype("<i8"), first[~again], shared.astype("u1")]
            uids, told = deal(uid[again], [first[again]])
            return dealt_rows(*deal(fragment_of(one, fragments), columns), uids, told, fragments)

        for part in slices(batches):
            data, bounds = utf8(part.column(1))
            pieces = Pieces(data, bounds)
            if not len(pieces.first):
                continue
            crowded, uid = _among(pieces.hash, table.value), np.asarray(part.column(0))
            rare = ~crowded
            first, doc, h = pieces.first[rare], pieces.doc[rare], pieces.hash[rare]
            if crowded.any():
                one, of, own = _strings(pieces, crowded)
                first, doc, h = np.append(first, one), np.append(doc, of), np.append(h, own)
            held.append((h, uid[doc], first - bounds[doc]))
            total += len(h)
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
            low, high, uid, first, shared = undeal(blobs, kinds)
            h = low.astype(_U) | high.astype(_U) << _U(32)
            order = np.argsort(h, kind="stable")
            alike = h[order][1:] == h[order][:-1]
            several = order[np.append(False, alike) | np.append(alike, False) | (shared[order] > 0)]
            if len(several):
                yield about(uid[several], [first[several]])

    dealt = numbered.select("uid", "text").mapInArrow(send, DEALT)
    return gathered(dealt, parts).mapInArrow(meet, ABOUT)


def _ranges(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Ranges by document, those that touch joined."""
    order = np.argsort(uid, kind="stable")
    uid, start, end = uid[order], start[order], end[order]
    at = np.flatnonzero(np.append(True, uid[1:] != uid[:-1])) if len(uid) else np.empty(0, np.int64)
    out = []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(uid)]):
        x, y = spans_of(start[a:b], end[a:b])
        out.append(blob([x.astype("<u4"), y.astype("<u4")]))
    return uid[at].tolist(), out


def _pack(pieces: list[tuple[int, int, int, bytes]]) -> bytes:
    h, uid, first, text = zip(*pieces)
    head = [np.array(h, "<u8"), np.array(uid, "<i8"), np.array(first, "<u4"), np.array([len(t) for t in text], "<u2")]
    body = b"".join(text)
    return np.array([len(pieces), len(body)], "<u4").tobytes() + b"".join(c.tobytes() for c in head) + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def _unpack(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    n, size = np.frombuffer(data, "<u4", 2).tolist()
    head, at = [], 8
    for kind in ("<u8", "<i8", "<u4", "<u2"):
        head.append(np.frombuffer(data, kind, n, at).tolist())
        at += n * np.dtype(kind).itemsize
    body, at = pa.decompress(data[at:], size, "zstd", asbytes=True), 0
    for h, uid, first, length in zip(*head):
        yield h, uid, first, body[at : at + length]
        at += length


def repeated_strings(numbered: DataFrame, told: DataFrame, crowd: tuple[np.ndarray, np.ndarray], parts: int, fragments: int) -> DataFrame:
    """For each document the ranges that repeat earlier strings (rows of deal.ABOUT: start, end)."""
    table = numbered.sparkSession.sparkContext.broadcast(crowd[0])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        known: list[tuple[int, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            by: dict[int, list[tuple[int, int, int, bytes]]] = {}
            for text, (uid, first, h) in seen.items():
                by.setdefault((h >> 40) * fragments >> 24, []).append((h, uid, first, text))
            uids, ranges = _ranges(*(np.array(c, dtype=np.int64) for c in zip(*known))) if known else ([], [])
            return dealt_rows([*by], [*map(_pack, by.values())], uids, ranges, fragments)

        for part in slices(batches, 2):
            part = part.filter(part.column(3).is_valid())
            if not part.num_rows:
                continue
            data, bounds = utf8(part.column(2))
            pieces = Pieces(data, bounds)
            uid = part.column(0).to_pylist()
            mark = np.sort(np.concatenate([undeal(records, ["<u4"])[0] + bounds[d] for d, records in enumerate(part.column(3).to_pylist())]))
            k = np.searchsorted(pieces.first, mark, "right") - 1  # the piece of each mark
            crowded = _among(pieces.hash, table.value)[k]
            text_end = np.where(crowded, mark, pieces.first[k] + pieces.count[k] - 1) + LENGTH
            h = pieces.hash[k].copy()
            if crowded.any():
                h[crowded] = range_hashes(data, mark[crowded], mark[crowded] + LENGTH)
            doc = pieces.doc[k]
            raw = data.tobytes()
            for a, b, d, x, place in zip(mark.tolist(), text_end.tolist(), doc.tolist(), h.tolist(), (mark - bounds[doc]).tolist()):
                text, me = raw[a:b], uid[d]
                before = seen.get(text)
                if before is None:
                    seen[text] = (me, place, x)
                    size += b - a
                    continue
                if (me, place) < before[:2]:
                    seen[text] = (me, place, x)
                    me, place = before[:2]
                known.append((me, place, place + b - a))
            if size > HELD_BYTES or len(known) > HELD:
                yield out()
                seen, known, size = {}, [], 0
        if seen or known:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragment, blobs in by_fragment(batches):
            if fragment is None:
                yield blobs
                continue
            found: list[tuple[int, int, int]] = []
            pieces: dict[bytes, tuple[int, int, int]] = {}
            for data in blobs:
                for h, uid, first, text in _unpack(data):
                    before = pieces.get(text)
                    if before is None or (uid, first) < before[:2]:
                        pieces[text] = (uid, first, h)
                        if before is None:
                            continue
                        uid, first = before[:2]
                    found.append((uid, first, first + len(text)))
            buckets: dict[int, list[tuple[bytes, int, int]]] = {}
            for text, (uid, first, h) in pieces.items():
                buckets.setdefault(h, []).append((text, uid, first))
            held = [(k, *p) for k, b in enumerate(x for x in buckets.values() if len(x) > 1) for p in b]
            pieces, buckets = {}, {}
            if held:
                bucket, text, uid, first = zip(*held)
                size = np.array([len(t) for t in text])
                begin, count = np.cumsum(size) - size, size - LENGTH + 1
                inner = spread(count)
                start = np.repeat(begin, count) + inner
                uid, place = np.repeat(np.array(uid), count), np.repeat(np.array(first), count) + inner
                rank = np.empty(len(start), dtype=np.int64)
                rank[np.lexsort((place, uid))] = np.arange(len(start))
                ranks, again = rank.tolist(), []
                for group in deep_shallow(np.frombuffer(b"".join(text), np.uint8), start, np.repeat(np.array(bucket), count)):
                    least = min(group, key=ranks.__getitem__)
                    again += [i for i in group if i != least]
                if again:
                    again = np.array(again)
                    a = place[again]
                    uids, ranges = _ranges(uid[again], a, a + LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ranges, pa.binary())], ["uid", "records"])
            if found:
                uids, ranges = _ranges(*(np.array(c) for c in zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(ranges, pa.binary())], ["uid", "records"])

    # A left join, as at the end, so that both use one exchange of the texts.
    dealt = with_records(numbered, told).mapInArrow(send, DEALT)
    return gathered(dealt, parts).mapInArrow(meet, ABOUT)


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, bytes that go, maximal runs of them, and the rest's SHA-256 (and text)."""
    numbered, _ = identified(docs)
    size = text_bytes(numbered)
    parts = partitions(docs.sparkSession, 2 * size)
    fragments = fragments_of(parts, 2 * size)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in slices(batches):
            yield Pieces(*utf8(part.column(1))).hash

    crowd = frequent_prints(numbered.select("uid", "text"), hashes, CROWD, size)
    told = compared(numbered, crowd, parts, fragments)
    records = repeated_strings(numbered, told, crowd, parts, fragments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            data, bounds = utf8(part.column(2))
            raw, rows = data.tobytes(), []
            for d, known in enumerate(part.column(3).to_pylist()):
                at, end = int(bounds[d]), int(bounds[d + 1])
                a, b = undeal(known or [], ["<u4", "<u4"])
                a, b = spans_of(a.astype(np.int64), b.astype(np.int64))
                kept = b"".join([raw[at + x : at + y] for x, y in zip([0, *b.tolist()], [*a.tolist(), end - at])])
                rows.append((end - at, end - at - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
            columns = list(zip(*rows))
            arrays = [part.column(1), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            if with_text:
                arrays, names = [*arrays, pa.array(columns[4], pa.string())], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return with_records(numbered, records).mapInArrow(run, SCHEMA + (", text string" if with_text else ""))
