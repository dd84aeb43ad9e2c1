"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a maximal stretch with a smallest period ``q`` that repeats at least twice.  Its last square
(two equal halves of ``q`` words) is *branching*: the word after it breaks the period.  So the two
halves' suffixes lie in one LCP interval of depth ``q``, in different children.  For every interval the
suffixes of all children but the largest look up ``ISA[i + q]`` and ``ISA[i - q]``; that finds every
branching square in ``O(n log n)`` tests.  A square rotated left as long as it stays a square is its run.
Intervals are ranges of the suffix array; there are no tree nodes.

Documents are independent, so nothing is shuffled.  A task handles the documents of an Arrow batch
together, up to :data:`CHUNK` words at a time: words are numbered anew for every document, so suffixes of
different documents never share a prefix.  Memory is about 200 bytes a word of the chunk, or of one
longer document.  Words and suffixes are compared exactly, never by hash.

Null and empty texts have no words and no runs.  Rows are independent, so null or repeated keys, repeated
rows and further columns of any name have no effect on each other.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

LEAST_WORDS, LEAST_EXPONENT = 6, 4
CHUNK = 1 << 18
# Words compared at once while a square is rotated.
STRIDE = 64

RUN = "struct<start bigint, length bigint, period bigint>"


def _numbered(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, a unique one after each document, and where documents start."""
    numbers, starts, used = [], [], 0
    for words in docs:
        starts.append(len(numbers))
        vocabulary = dict.fromkeys(words)
        own = dict(zip(vocabulary, range(used, used + len(vocabulary)), strict=True))
        numbers.extend(map(own.__getitem__, words))
        used += len(vocabulary) + 1
        numbers.append(used - 1)
    return np.array(numbers, np.int64), np.array(starts, np.int64)


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, its inverse and the LCP array of numbers of which the last is unique.

    Prefix doubling; a round sorts only suffixes that are not told apart yet.  The ranks of every
    round are kept until the LCP values are read off them, longest prefix first.
    """
    n = len(s)
    sa = np.argsort(s, kind="stable")
    ranked = s[sa]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, depth = [rank.astype(np.int32)], 1
    while True:
        single = first & np.concatenate((first[1:], [True]))
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        at = sa[slots]
        key = rank[at] * n + rank[at + depth]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank.astype(np.int32))
        depth *= 2
    lcp = np.zeros(n, np.int64)
    near = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b, found = sa[near - 1], sa[near], np.zeros(len(near), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        found += (levels[k][a + found] == levels[k][b + found]).astype(np.int64) << k
    lcp[near] = found
    return sa, rank, lcp


def _nearest(lcp: np.ndarray, at: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For each place in ``at`` the nearest one before (step -1) or after (1) with an LCP not larger, or smaller if strict.

    Pointer jumping: what lies between a place and its pointer is too large for it.
    """
    to = np.arange(len(lcp)) + step
    left = at
    while len(left):
        seen = lcp[to[left]]
        left = left[seen >= lcp[left] if strict else seen > lcp[left]]
        to[left] = to[to[left]]
    return to[at]


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of all squares whose next number breaks the period."""
    sa, isa, lcp = suffix_array(s)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return at, at
    walls = np.concatenate((lcp, [-1]))
    walls[0] = -1
    before, low = _nearest(walls, at, -1, False), _nearest(walls, at, -1, True)
    after, high = _nearest(walls, at, 1, False), _nearest(walls, at, 1, True)
    # Every boundary closes the child on its left; the last one of an interval opens the last child.
    last = after == high
    begin, end = np.concatenate((before, at[last])), np.concatenate((at, after[last]))
    low, high = np.concatenate((low, low[last])), np.concatenate((high, high[last]))
    depth = np.concatenate((lcp[at], lcp[at[last]]))
    order = np.lexsort((end - begin, high, low))
    largest = np.concatenate(((low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]), [True]))
    small = order[~largest]
    sizes = (end - begin)[small]
    which = np.repeat(small, sizes)
    i = sa[np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[which]]
    d, low, high = depth[which], low[which], high[which]
    n = len(s)

    def inside(j):
        place = isa[np.clip(j, 0, n - 1)]
        return (j >= 0) & (place >= low) & (place < high)

    right = inside(i + d)
    right[right] = s[(i + d)[right]] != s[(i + 2 * d)[right]]
    left = inside(i - d)
    left[left] = s[i[left]] != s[(i + d)[left]]
    squares = np.unique(np.concatenate((i[right] * n + d[right], (i - d)[left] * n + d[left])))
    return squares // n, squares % n


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and smallest periods of all runs of exponent 2 or more.

    Squares that end at the same place are taken by length: one that lies in a run already found
    there only repeats its period several times over.
    """
    start, half = branching_squares(s)
    end = start + 2 * half
    order = np.lexsort((half, end))
    start, half, end = start[order], half[order], end[order]
    found = []
    while len(start):
        first = np.concatenate(([True], end[1:] != end[:-1]))
        begin = _rotated(s, start[first], half[first])
        found.append((begin, end[first], half[first]))
        group = np.cumsum(first) - 1
        left = ~first & (start < begin[group])
        start, half, end = start[left], half[left], end[left]
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))


def _rotated(s: np.ndarray, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Where squares begin when rotated left as far as they stay squares."""
    begin, active = start.copy(), np.arange(len(start))
    steps = np.arange(1, STRIDE + 1)
    while len(active):
        at = begin[active, None] - steps
        same = (at >= 0) & (s[np.maximum(at, 0)] == s[np.maximum(at, 0) + half[active, None]])
        held = np.cumprod(same, axis=1).sum(axis=1)
        begin[active] -= held
        active = active[held == STRIDE]
    return begin


def document_runs(
    docs: list[list[bytes]], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT,
) -> list[list[tuple[int, int, int]]]:
    """Per document its ``(start, length, period)``, ordered by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    s, starts = _numbered(docs)
    if not len(s):
        return found
    begin, end, period = runs(s)
    keep = end - begin >= np.maximum(least_words, least_exponent * period)
    begin, end, period = begin[keep], end[keep], period[keep]
    doc = np.searchsorted(starts, begin, "right") - 1
    for k in np.lexsort((period, begin)):
        found[doc[k]].append((int(begin[k] - starts[doc[k]]), int(end[k] - begin[k]), int(period[k])))
    return found


def collapsed_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what a run repeats after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _chunks(docs: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for words in docs:
        if chunk and size + len(words) > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(words)
        size += len(words)
    yield chunk


def collapsed(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """Per row ``key, runs, collapsed``: the text's runs by start and period, and its words without the repeats, joined by one space."""
    key_type = docs.schema[key].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in texts(batches, "text"):
            words = [(value or "").encode().split() for value in values]
            rows, kept = [], []
            for chunk in _chunks(words):
                for doc, own in zip(chunk, document_runs(chunk, least_words, least_exponent), strict=True):
                    rows.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                    kept.append(b" ".join(collapsed_words(doc, own)).decode())
            run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(run)), pa.array(kept, pa.string())], names=["key", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(found, f"key {key_type}, runs array<{RUN}>, collapsed string").withColumnRenamed("key", key)
