"""Quality rules from a suffix array over words.

For every document the suffixes that begin with a five-word window seen twice in
that document are put in suffix-array order by prefix doubling.  The longest
common prefix of neighbours gives, for each position, the longest substring that
starts there and occurs elsewhere in the document; the intervals of equal prefix
are the maximal repeated substrings.  The union of their spans and the longest of
them are limited.

Defined cases: a null, empty or white-space text has no words and fails the base
rule (fewer than 10 words); repeated rows, null ids and extra columns pass through
unchanged, since each row is judged alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, by_position, place_of, slices, texts, utf8, window_hashes

#: A text needs this many words, and at most this share of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Repeated substrings of at least this many words count; limits on their union and the longest.
SPAN_WORDS, MAX_COVERED_PERCENT, MAX_LONGEST = 10, 20, 100

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_words long, longest_repeat long, n_repeats long"
)


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of its run of equal keys, and the run's length, for sorted keys."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(keys)))
    return np.repeat(at, size), np.repeat(size, size)


def suffix_repeats(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions in suffix-array order, the prefix each shares with the one before it,
    the longest prefix each shares with any other, and all words in repeated windows.

    Only suffixes whose first `size` words occur twice in their document take part.
    """
    n = len(words.hash)
    at, h = window_hashes(words, size)
    none = np.empty(0, np.int64)
    key = h + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    first, count = _runs(key[order])
    again = count > 1
    if not again.any():
        return none, none, none, np.zeros(n, dtype=bool)
    rank = np.full(n, -1, dtype=np.int32 if n < 1 << 31 else np.int64)
    rank[at[order]] = first
    active = at[order[again]]
    start_group = rank[active].copy()
    repeated = _covered(active, np.full(len(active), size), n)

    # Prefix doubling: a group is split by the rank of what follows `step` words on.  Each
    # round keeps only the ranks that it changes, as they were before.
    rounds, step = [], size
    pending = active
    while len(pending):
        ahead = pending + step
        inside = ahead < n
        follow = np.full(len(pending), -1, dtype=np.int64)
        same = np.zeros(len(pending), dtype=bool)
        same[inside] = words.doc[ahead[inside]] == words.doc[pending[inside]]
        follow[same] = rank[ahead[same]]
        # Suffixes are ordered by their next words (0 beyond the document), then by rank: a
        # shorter rest than a window is told apart by those words alone.
        follow[follow < 0] = -1 - pending[follow < 0]
        following = []
        for k in range(size):
            p = np.minimum(ahead + k, n - 1)
            within = (ahead + k < n) & (words.doc[p] == words.doc[pending])
            following.append(np.where(within, words.hash[p], np.uint64(0)))
        group = rank[pending]
        sort = np.lexsort((follow, *following[::-1], group))
        pending, group, follow = pending[sort], group[sort], follow[sort]
        head, _ = _runs(group)
        change = np.ones(len(pending), dtype=bool)
        change[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        at_change = np.flatnonzero(change)
        width = np.diff(np.append(at_change, len(pending)))
        sub = np.repeat(at_change, width)
        moved = sub != head
        rounds.append((step, pending[moved].astype(rank.dtype), group[moved].astype(rank.dtype)))
        rank[pending] = group + sub - head
        step *= 2
        pending = pending[np.repeat(width, width) > 1]

    sort = np.argsort(rank[active], kind="stable")
    order, groups = active[sort], start_group[sort]
    shared = np.zeros(len(order), dtype=np.int64)
    left, right = order[:-1], order[1:]
    pair = groups[1:] == groups[:-1]
    left, right = left[pair], right[pair]
    length = np.zeros(len(left), dtype=np.int64)
    while True:  # from the last round's ranks (equal over `step` words) back to the first
        a, b = left + length, right + length
        ok = (a + step <= n) & (b + step <= n)
        ok[ok] = (words.doc[a[ok] + step - 1] == words.doc[left[ok]]) & (words.doc[b[ok] + step - 1] == words.doc[right[ok]])
        ok[ok] = (rank[a[ok]] == rank[b[ok]]) & (rank[a[ok]] >= 0)
        length[ok] += step
        if not rounds:
            break
        step, changed, before = rounds.pop()
        rank[changed] = before
    for _ in range(size - 1):  # what is left is shorter than a window
        a, b = left + length, right + length
        ok = (a < n) & (b < n)
        ok[ok] = (words.hash[a[ok]] == words.hash[b[ok]]) & (words.doc[a[ok]] == words.doc[left[ok]]) & (words.doc[b[ok]] == words.doc[right[ok]])
        length[ok] += 1
    shared[1:][pair] = length
    longest = shared.copy()
    np.maximum(longest[:-1], shared[1:], out=longest[:-1])
    return order, shared, longest, repeated


def lcp_intervals(shared: np.ndarray, least: int) -> np.ndarray:
    """For each index of the suffix array: whether an interval of common prefix >= least begins there."""
    over = shared >= least
    begins = np.zeros(len(shared), dtype=bool)
    begins[:-1] = over[1:] & ~over[:-1]
    return begins


def _seen_before(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a line's bytes are those of an earlier line of its document."""
    raw, last, seen, out = data.tobytes(), -1, set(), np.zeros(len(starts), dtype=bool)
    for k, (a, b, d) in enumerate(zip(starts.tolist(), stops.tolist(), doc.tolist())):
        if d != last:
            last, seen = d, set()
        line = raw[a:b]
        if line in seen:
            out[k] = True
        else:
            seen.add(line)
    return out


def measure(data: np.ndarray, bounds: np.ndarray, span: int, cover: int, longest: int) -> dict[str, np.ndarray]:
    words = Words(data, bounds)
    docs, n = words.docs, len(words.hash)
    counts = words.counts.astype(np.int64)
    out = {"n_words": counts, "word_chars": _per_doc(words.inside & ((data & 0xC0) != 0x80), bounds), "n_symbols": _per_doc(_SYMBOL[data], bounds)}

    # Lines that hold a word; each but the first of its kind in the document is a repeat.
    breaks = np.flatnonzero(data == 10)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    edge[breaks + 1] = True
    starts = np.flatnonzero(edge[: len(data)])
    line_doc = np.searchsorted(bounds, starts, "right") - 1
    stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], bounds[line_doc + 1])
    held = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(words.inside, out=held[1:])
    some = held[stops] > held[starts]
    starts, stops, line_doc = starts[some], stops[some], line_doc[some]
    out["n_dup_lines"] = np.bincount(line_doc[_seen_before(data, starts, stops, line_doc)], minlength=docs).astype(np.int64)

    order, shared, reach, repeated = suffix_repeats(words)
    out["n_repeat_words"] = np.bincount(words.doc[repeated], minlength=docs).astype(np.int64) if n else np.zeros(docs, np.int64)
    long = reach >= span
    spans = _covered(order[long], reach[long], n)
    out["covered_words"] = np.bincount(words.doc[spans], minlength=docs).astype(np.int64) if n else np.zeros(docs, np.int64)
    top = np.zeros(docs, dtype=np.int64)
    np.maximum.at(top, words.doc[order], reach)
    out["longest_repeat"] = top
    begins = lcp_intervals(shared, span) if len(shared) else np.empty(0, dtype=bool)
    out["n_repeats"] = np.bincount(words.doc[order[begins]], minlength=docs).astype(np.int64) if n else np.zeros(docs, np.int64)
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * counts)
    out["kept"] = ~out["base_failed"] & (100 * out["covered_words"] <= cover * counts) & (top <= longest)
    return out


def quality_scores(docs: DataFrame, span_words: int = SPAN_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per document: doc_id, the base counts and the verdict of the suffix-array rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = measure(*utf8(part.column(1)), span_words, max_covered_percent, max_longest)
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[c]) for c in names)], ["doc_id", *names])

    return texts(docs).mapInArrow(run, f"doc_id long, {COLUMNS}")


def quality_filter(docs: DataFrame, span_words: int = SPAN_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The documents that the rules keep, with all their columns, in one pass and without a shuffle."""
    plain, names = by_position(docs)
    at = place_of(names, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            got = measure(*utf8(part.column(at)), span_words, max_covered_percent, max_longest)
            yield part.filter(pa.array(got["kept"]))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
