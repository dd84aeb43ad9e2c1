"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte is removed if it lies in a string of :data:`SPAN` bytes that also starts anywhere else.  Suffixes are
sorted at *anchors* only: the anchor of a window of ``SPAN`` bytes is the start in it whose next
:data:`HEAD` bytes have the smallest hash, the first one if several have it.  That depends on the window's bytes
alone, so equal windows have their anchors at the same offset, and an anchor stands for a range of
windows around it.  There is one anchor in about 85 bytes.  Nothing is approximate: whether windows are
equal is read off common prefixes of what follows their anchors and of what precedes them.

1. Heads of anchors are counted.  An anchor whose head occurs once has no repeated window.  Heads that occur
   more often go into a bitmap of bounded size, by which the next scan leaves the others out; the fuller it is,
   the less it leaves out.
2. Every task sorts its anchors by the head's hash and the bytes that follow, and cuts the sorted run
   into ranges of hashes.  The runs are front-coded: a suffix is the length of the prefix it shares with the one
   before, and the rest.  Ranges of a hash are even whatever the text is, so there are no splitters to find.
3. One task merges the runs of a range by a loser tree that keeps, with each loser, how much it shares with the
   winner.  The larger shared prefix wins without a look at the bytes; equal ones are compared from there on.
   The merge yields the suffixes' common prefixes, with which windows are compared offset by offset.
4. Removed spans come back to the texts that have any.

Hot passages: a task sends at most two copies of an equal text or of equal surroundings of an anchor; it knows
of further ones that they are repeated.  Heads with more than a bounded share of all anchors (so at most
:data:`HOT_SHARE` of them) are left out of the ranges: their windows are compared by 128-bit digests,
added up by task and spread by digest.  So no range grows with a single passage.

Matches never cross documents.  Null texts are empty; texts below ``SPAN`` bytes lose nothing.  Equal texts
lose the same, all of it if they have ``SPAN`` bytes.  Keys are passed on and may be null, repeated and of any
type; other columns are not read.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_filter, mix64, texts, written

SPAN, HEAD = 200, 32
STARTS = SPAN - HEAD + 1
# Bytes looked at together; a longer text is cut into pieces that overlap by a window.
PIECE = 1 << 20
# Anchors that a range holds on average; anchors and bytes that a task sorts at once.
RANGE_ANCHORS, RUN_BYTES = 16_000, 24 << 20
COUNTED = 1 << 20
# The spans of so many ranges of anchors meet in one range of texts.
RANGES_A_TEXT_RANGE = 8
LEAST_BITS, MOST_BITS = 20, 28
# A head is hot with more than 1 / HOT_SHARE of all anchors, if these are many.
HOT_SHARE, HOT_LEAST = 512, 2000
DIGEST = 16

_RANDOM = np.random.default_rng(1414213562)
BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 63, (5, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

RUN = pa.schema([("shared", pa.int16()), ("rest", pa.binary()), ("before", pa.binary()), ("node", pa.binary()), ("at", pa.int64())])
WINDOWS = pa.schema([("window", pa.binary()), ("node", pa.binary()), ("start", pa.int64()), ("n", pa.int64())])
SPANS = pa.schema([("node", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``HEAD`` bytes from each position."""
    h, width = BYTES[data], 1
    for first, second in FACTORS:
        joined = h[:-width] * first
        joined += h[width:]
        joined ^= joined >> np.uint64(32)
        joined *= second
        joined ^= joined >> np.uint64(29)
        h, width = joined, 2 * width
    return h


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """``(piece, at, first, last, head)`` of all anchors of pieces: positions of anchor, first and last window, hash of the head."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - SPAN + 1, 0)
    if not counts.sum():
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint64))
    owner = np.repeat(np.arange(len(pieces)), counts)
    x = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    heads = head_hashes(data)
    least = (heads & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(heads), dtype=np.uint64)
    width = 1
    while 2 * width <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = STARTS - width
    at = (np.minimum(least[x], least[x + rest]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((fresh[1:], [len(at)])) - 1
    owner = owner[fresh]
    base = begins[owner]
    # Hashes of anchors are the smallest around; mixed once more they are even again.
    return owner, at[fresh] - base, x[fresh] - base, x[last] - base, mix64(heads[at[fresh]])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes], list[int]]]:
    """Pieces of a task's texts with their text's digest and offset, a megabyte at a time; equal texts twice at most."""
    seen: Counter[bytes] = Counter()
    pieces, nodes, offsets, size = [], [], [], 0
    for _, found in texts(batches, "text"):
        for value in found:
            data = (value or "").encode()
            if len(data) < SPAN:
                continue
            node = hashlib.sha256(data).digest()[:DIGEST]
            seen[node] += 1
            if seen[node] > 2:
                continue
            for begin in range(0, len(data) - SPAN + 1, PIECE):
                piece = data[begin : begin + PIECE + SPAN - 1]
                if pieces and size + len(piece) > PIECE:
                    yield pieces, nodes, offsets
                    pieces, nodes, offsets, size = [], [], [], 0
                pieces.append(piece)
                nodes.append(node)
                offsets.append(begin)
                size += len(piece)
    if pieces:
        yield pieces, nodes, offsets


def _counted_heads(docs: DataFrame) -> DataFrame:
    """``head, n``: heads of two anchors or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            heads, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(heads.view(np.int64)), pa.array(n)], names=["head", "n"])

        for pieces, _, _ in _pieces(batches):
            held.append(anchors(pieces)[-1])
            size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(count, "head bigint, n bigint").groupBy("head").agg(F.sum("n").alias("n")).where("n > 1")


def _bitmap(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """A bitmap with a bit set for each key: eight bits a key, ``2 ** MOST_BITS`` bits at most."""
    bits = min(max(LEAST_BITS, math.ceil(math.log2(8 * count + 1))), MOST_BITS)
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    one = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    found = np.zeros(1 << bits - 6, np.int64)
    found[words["word"].to_numpy()] = words["bits"].to_numpy()
    return found


def _packed(schema: pa.Schema, rows: list[tuple]) -> bytes:
    """Rows as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list[list]:
    """The columns of :func:`_packed`."""
    return [c.to_pylist() for c in pa.ipc.open_stream(blob).read_all().columns]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    n = min(len(a), len(b))
    differing = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (differing.bit_length() + 7) // 8


def front_coded(records: list[tuple[bytes, bytes, bytes, int]]) -> list[tuple]:
    """Sorted ``(suffix, before, node, at)`` with each suffix as the prefix shared with the one before and the rest."""
    out, last = [], b""
    for suffix, *others in records:
        shared = common(last, suffix)
        out.append((shared, suffix[shared:], *others))
        last = suffix
    return out


def merged(runs: list[list[list]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Merge of front-coded runs (columns as of :data:`RUN`): ``(run, place in it, size of the suffix, shared with the one before)``.

    A loser tree.  ``shared`` of a contender says how long a prefix it has in common with the last
    winner; so of two contenders the one with more is smaller, and of equals the bytes before that need no look.
    """
    width = 1 << max(0, (len(runs) - 1).bit_length())
    size = [len(r[0]) for r in runs] + [0] * (width - len(runs))
    place, text = [0] * width, [b""] * width
    # Losers and what they share with who beat them; a run that has ended shares -1 and loses to all.
    loser, loser_shared = [0] * width, [0] * width

    def contest(a: int, na: int, b: int, nb: int) -> tuple[int, int, int, int]:
        """(winner, what it shares with the last winner, loser, what it shares with its winner)."""
        if na > nb:
            return a, na, b, nb
        if nb > na:
            return b, nb, a, na
        if na < 0:
            return a, na, b, nb
        x, y = text[a], text[b]
        n = common(x, y, na)
        if x[n : n + 1] <= y[n : n + 1]:
            return a, na, b, n
        return b, nb, a, n

    def first(node: int) -> tuple[int, int]:
        if node >= width:
            leaf = node - width
            if not size[leaf]:
                return leaf, -1
            text[leaf] = runs[leaf][1][0]
            return leaf, 0
        winner, n, loser[node], loser_shared[node] = contest(*first(2 * node), *first(2 * node + 1))
        return winner, n

    winner, n = first(1)
    from_run, from_place, sizes, shared = [], [], [], []
    while n >= 0:
        own = text[winner]
        from_run.append(winner)
        from_place.append(place[winner])
        sizes.append(len(own))
        shared.append(n)
        k = place[winner] = place[winner] + 1
        if k < size[winner]:
            columns = runs[winner]
            n = columns[0][k]
            text[winner] = own[:n] + columns[1][k]
        else:
            n = -1
        node = (width + winner) >> 1
        while node:
            m = loser_shared[node]
            if m > n or (m == n and n >= 0):
                winner, n, loser[node], loser_shared[node] = contest(winner, n, loser[node], m)
            node >>= 1
    return from_run, from_place, sizes, shared


def _tagged(part: int, kind: str, schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([kind]), pa.array([_packed(schema, rows)], pa.binary())], names=["part", "kind", "rows"])


def _by_part(rows: list[tuple], parts: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows whose first field is bytes that begin with a hash, in ranges of that hash."""
    ranges: dict[int, list[tuple]] = {}
    for row in rows:
        ranges.setdefault(int.from_bytes(row[0][:8]) * parts >> 64, []).append(row)
    yield from ranges.items()


def _sent(docs: DataFrame, wanted: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """``part, kind, rows``: every task's front-coded runs, windows of hot anchors and spans it is sure of."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size, sure = [], 0, []
        windows: dict[bytes, list] = {}

        def flush_records():
            records.sort()
            kept, times, last = [], 0, None
            for record in records:
                times = times + 1 if record[:2] == last else 1
                last = record[:2]
                if times <= 2:
                    kept.append(record)
                else:
                    suffix, before, node, at = record
                    sure.append((node, at - len(before), at + len(suffix) - 8))
            for part, own in _by_part(kept, parts):
                yield _tagged(part, "run", RUN, front_coded(own))
            records.clear()

        def flush_windows():
            rows = [(window, *found) for window, found in windows.items()]
            for part, own in _by_part(rows, parts):
                yield _tagged(part, "windows", WINDOWS, own)
            windows.clear()

        def flush_sure():
            for part, own in _by_part(sure, parts):
                yield _tagged(part, "spans", SPANS, own)
            sure.clear()

        for pieces, nodes, offsets in _pieces(batches):
            piece, at, begin, end, head = anchors(pieces)
            keep = in_filter(wanted, head.view(np.int64))
            is_hot = np.isin(head, hot)
            keys = head.astype(">u8").tobytes()
            for k in np.flatnonzero(keep):
                p, node, offset = pieces[piece[k]], nodes[piece[k]], offsets[piece[k]]
                a, i, j = int(at[k]), int(begin[k]), int(end[k])
                if is_hot[k]:
                    for x in range(i, j + 1):
                        window = hashlib.blake2b(p[x : x + SPAN], digest_size=DIGEST).digest()
                        if (known := windows.get(window)) is None:
                            windows[window] = [node, offset + x, 1]
                            continue
                        if known[2] == 1:
                            known[2] = 2
                            sure.append((known[0], known[1], known[1] + SPAN))
                        sure.append((node, offset + x, offset + x + SPAN))
                else:
                    records.append((keys[8 * k : 8 * k + 8] + p[a : j + SPAN], p[i:a][::-1], node, offset + a))
                    size += j + SPAN - i + 150
            if size >= RUN_BYTES:
                yield from flush_records()
                size = 0
            if len(windows) >= COUNTED // 4:
                yield from flush_windows()
            if len(sure) >= COUNTED // 4:
                sure[:] = _joined(sure)
                yield from flush_sure()
        yield from flush_records()
        yield from flush_windows()
        sure[:] = _joined(sure)
        yield from flush_sure()

    return docs.mapInArrow(send, "part bigint, kind string, rows binary")


def _joined(spans: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
    """The spans of each text, overlapping and touching ones as one."""
    out: list[list] = []
    for node, start, stop in sorted(set(spans)):
        if out and out[-1][0] == node and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([node, start, stop])
    return [tuple(x) for x in out]


def _group_ids(shared: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the stretches of a sorted list within which neighbours share ``least`` or more."""
    return np.cumsum(shared < least)


def repeated_spans(runs: list[list[list]]) -> list[tuple[bytes, int, int]]:
    """Spans of the windows that occur twice or more among the anchors of all runs of a range.

    A window that starts ``t`` bytes before its anchor equals another one just if the anchors share
    the ``SPAN - t`` bytes from there on and the ``t`` bytes before.  Sorted by the former, and once more by
    the latter, anchors that share so much are neighbours.
    """
    from_run, from_place, sizes, shared = merged(runs)
    m = len(sizes)
    if m < 2:
        return []
    before = [runs[r][2][k] for r, k in zip(from_run, from_place, strict=True)]
    follow = np.maximum(np.array(shared) - 8, 0)  # a suffix starts with the 8 bytes of the head's hash
    follow[0] = 0
    order = sorted(range(m), key=before.__getitem__)
    precede = np.array([0, *(common(before[a], before[b]) for a, b in zip(order, order[1:], strict=False))])
    order = np.array(order)
    least, most = SPAN - (np.array(sizes) - 8), np.array([len(b) for b in before])
    repeated = np.zeros((m, SPAN + 2), bool)  # a column for each offset, one empty on either side
    back = np.empty(m, np.int64)
    for t in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= t) & (t <= most))
        back[order] = _group_ids(precede, t)
        group = _group_ids(follow, SPAN - t)[own] * (m + 1) + back[own]
        by_group = np.argsort(group, kind="stable")
        ranked = group[by_group]
        same = ranked[1:] == ranked[:-1]
        repeated[own[by_group[1:][same]], t + 1] = True
        repeated[own[by_group[:-1][same]], t + 1] = True
    edges = repeated[:, 1:] != repeated[:, :-1]
    which, t = np.nonzero(edges)
    # Edges come in pairs: the first offset of a stretch, and the one after its last.
    which, low, high = which[::2], t[::2], t[1::2] - 1
    found = []
    for k, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True):
        columns = runs[from_run[k]]
        at = columns[4][from_place[k]]
        found.append((columns[3][from_place[k]], at - b, at - a + SPAN))
    return found


def repeated_windows(blobs: list[list[list]]) -> list[tuple[bytes, int, int]]:
    """Spans of windows that several tasks have; a task has settled those that it has twice."""
    total: Counter[bytes] = Counter()
    for window, _, _, n in blobs:
        for w, k in zip(window, n, strict=True):
            total[w] += k
    return [
        (node, start, start + SPAN)
        for columns in blobs for w, node, start, n in zip(*columns, strict=True) if n == 1 and total[w] > 1
    ]


def _resolved(ranges: int):
    """The function that settles a range of anchors: ``texts, rows``, its spans packed by ranges of texts."""

    def resolve(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_pylist()
        blobs = [_unpacked(b) for b in group["rows"].to_pylist()]
        of = lambda kind: [b for k, b in zip(kinds, blobs, strict=True) if k == kind]
        found = repeated_spans(of("run")) + repeated_windows(of("windows"))
        for columns in of("spans"):
            found += zip(*columns, strict=True)
        packed = [(n, _packed(SPANS, own)) for n, own in _by_part(_joined(found), ranges)]
        return pa.table({"texts": pa.array([n for n, _ in packed], pa.int64()), "rows": pa.array([b for _, b in packed], pa.binary())})

    return resolve


def _per_text(group: pa.Table) -> pa.Table:
    """``node, spans`` of a range of texts."""
    every = [row for blob in group["rows"].to_pylist() for row in zip(*_unpacked(blob), strict=True)]
    lists: dict[bytes, list[dict]] = {}
    for node, start, stop in _joined(every):
        lists.setdefault(node, []).append({"start": start, "stop": stop})
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.table({"node": pa.array(lists, pa.binary()), "spans": pa.array(lists.values(), pair)})


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``node, spans``: per distinct text with repeats the first 16 bytes of its SHA-256 and its removed ``(start, stop)``, in order and apart.

    A text's spans are as many as it is long at most.
    """
    rows = docs.select(F.col(text).alias("text")).where(F.octet_length("text") >= SPAN)
    heads = written(_counted_heads(rows), "heads")
    count, total = heads.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = [r["head"] for r in heads.where(F.col("n") > max(HOT_LEAST, total // HOT_SHARE)).select("head").collect()]
    wanted = _bitmap(heads, "head", count)
    parts = max(1, math.ceil(total / RANGE_ANCHORS))
    sent = _sent(rows, wanted, np.array(hot, np.int64).view(np.uint64), parts)
    ranges = math.ceil(parts / RANGES_A_TEXT_RANGE)
    found = sent.groupBy("part").applyInArrow(_resolved(ranges), "texts bigint, rows binary")
    return found.groupBy("texts").applyInArrow(_per_text, "node binary, spans array<struct<start bigint, stop bigint>>")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row ``key, n_bytes, n_removed, n_spans, kept``: sizes, maximal removed runs, and the bytes that are left (binary).

    Only texts that may have spans, by a bitmap of bounded size, are shuffled to meet them.
    """
    removed = written(spans(docs, text), "spans")
    removed = removed.select("node", "spans", F.xxhash64("node").alias("slot"))
    wanted = _bitmap(removed, "slot", removed.count())

    @F.pandas_udf("boolean")
    def maybe(slot: pd.Series) -> pd.Series:
        return pd.Series(in_filter(wanted, slot.to_numpy()))

    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), data.alias("data"))
    rows = rows.withColumn("node", F.substring(F.unhex(F.sha2("data", 256)), 1, DIGEST)).withColumn("maybe", maybe(F.xxhash64("node")))
    none = F.lit(0).cast("long")
    size = F.octet_length("data").cast("long").alias("n_bytes")
    clean = rows.where("not maybe").select("key", size, none.alias("n_removed"), none.alias("n_spans"), F.col("data").alias("kept"))
    met = rows.where("maybe").join(removed.select("node", "spans"), "node", "left")
    lost = F.aggregate("spans", none, lambda n, s: n + s["stop"] - s["start"])
    # What is left lies between the spans: from the end of one (or the start) to the next (or the end).
    ends = F.concat(F.array(none), F.transform("spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.col("n_bytes")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    met = met.withColumn("n_bytes", size).withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")))
    left = F.aggregate(pieces, F.lit(b""), lambda x, p: F.concat(x, F.substring(F.col("data"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    met = met.select("key", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), left.alias("kept"))
    return clean.unionByName(met).withColumnRenamed("key", key)
