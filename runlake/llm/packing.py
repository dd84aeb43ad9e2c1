"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenized where they lie; only documents longer than a sequence are cut.  How pieces
combine depends on their lengths alone, and there are at most ``capacity`` lengths, so the bins are
planned on the histogram of lengths: for each bin a subset-sum dynamic program over the available
lengths (a bitset, one bit per fill level) finds the fullest combination with the longest piece left,
which is removed as often as the counts allow.  The plan is a list of combinations, bounded by
``capacity`` alone, never by the data.  Each piece then finds its bin by arithmetic from its rank
among the pieces of its length; ranks are taken in hash buckets, so a length that holds a third of
all pieces is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from .common import Memo, texts, written

CAPACITY = 2048
END_ID = 0
LEAST_BUCKETS = 1024
PIECES_PER_BUCKET = 20_000
MARKS = ".,;:!?"
# Below this, lower-casing and composing letters are settled character by character, but for one letter.
FIRST_NOT_LATIN, DOTTED = "\u0250", "\u0130"


def _as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def token_memo(path: str) -> Memo:
    """Token ids (little-endian unsigned 32-bit) of single words, kept per Python worker.

    The tokenizer drops white space and treats what stands between it independently, so a text's ids
    are those of its words in turn.  Letters and closing marks are independent in the same way, which
    lets ``word`` and ``word,`` share an entry.  Words of Latin letters go straight to the model after
    lower-casing, as none of the other steps changes them; all else takes the whole tokenizer.
    """
    tokenizer = Tokenizer.from_file(path)
    lowers = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AÉ") == "aé"
    model, as_units = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def encode(word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(MARKS)
        if core.isalpha():
            if core != text:
                return memo[core.encode()] + memo[text[len(core):].encode()]
            if lowers and max(core) < FIRST_NOT_LATIN and DOTTED not in core:
                lower = core.lower()
                if lower != core:
                    return memo[lower.encode()]
                unit = core if core.isascii() else as_units.pre_tokenize_str(core)[0][0]
                return _as_bytes([token.id for token in model.tokenize(unit)])
        return _as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)

    memo = Memo(encode, 800_000)
    return memo


def tokenized(text: str | None, path: str, end_id: int = END_ID) -> bytes:
    """Ids of a text and the closing id, four bytes each; null text is empty text."""
    return b"".join(map(token_memo(path).__getitem__, (text or "").encode().split())) + _as_bytes([end_id])


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, cut at ``capacity`` ids."""
    key_type = docs.schema[key].dataType.simpleString()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in texts(batches, "text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(found):
                ids = tokenized(value, tokenizer)
                for number, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    plain = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(cut, f"doc_id {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Minimum bin slack for one bin: the longest length left, and what fills the rest best.

    ``fits`` has bit ``s`` set if some combination sums to ``s``.  A length's multiples enter as
    1, 2, 4, ... pieces, so each length costs a few shifts.
    """
    longest = max(counts)
    room = capacity - longest
    left = dict(counts)
    left[longest] -= 1
    steps, fits, full = [], 1, 1 << room
    mask = (1 << room + 1) - 1
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        most, part = min(left[length], room // length), 1
        while most > 0:
            take = min(part, most)
            steps.append((fits, length, take))
            fits |= fits << length * take & mask
            most, part = most - take, part * 2
        if fits & full:
            break
    chosen, level = {longest: 1}, fits.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> level & 1:
            chosen[length] = chosen.get(length, 0) + take
            level -= length * take
    return chosen


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(number of bins, {length: pieces per bin})`` for a histogram of lengths."""
    left = {k: v for k, v in counts.items() if v}
    plan = []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[k] // v for k, v in chosen.items())
        plan.append((times, chosen))
        for k, v in chosen.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return plan


class Places:
    """Where the piece of a length and rank stands."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]):
        used: dict[int, int] = {}
        rows, base = [], 0
        for times, chosen in plan:
            offset = 0
            for length, each in sorted(chosen.items(), reverse=True):
                first = used.get(length, 0)
                rows.append((length, first, base, each, offset))
                used[length] = first + times * each
                offset += length * each
            base += times
        rows.sort()
        self.length, self.first, self.base, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.bins = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets of pieces."""
        # Ranks stay far below 2 ** 50 and lengths below 2 ** 13.
        at = np.searchsorted((self.length << 50) + self.first, (length << 50) + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def packed(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    Null or empty text is one piece of length 1, the closing id.  Rows repeating an id are packed like
    any other; a null id stays null.  An empty table gives no rows.  What reaches the driver is a count
    per length, at most ``capacity`` rows.
    """
    pieces = written(token_pieces(docs, tokenizer, text, key, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = Places(bin_plan(counts, capacity))
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // PIECES_PER_BUCKET)
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    offsets = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("_nth", F.row_number().over(within)).join(offsets, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
