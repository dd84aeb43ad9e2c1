"""Helpers the operators share: tables, written work tables, words and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir

# A word is a run of anything but ASCII white space.  In Python, bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; the driver need not have installed it there."""
    context = spark.sparkContext
    if context.applicationId not in SHIPPED:
        SHIPPED.add(context.applicationId)
        top = Path(__file__).resolve().parents[2]
        # The driver serves this small file from its own disk until the application ends.
        folder = tempfile.mkdtemp(prefix="runlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder, f"runlake-{uuid.uuid4().hex[:8]}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(top.glob("runlake/**/*.py")):
                out.write(file, file.relative_to(top))
        context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a parquet table in the shared work folder, read back.

    It cuts the lineage, so a lost executor never repeats the work behind it, and the size that
    the planner then knows decides whether a join may broadcast it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark, purpose)}/{purpose}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 digest as a long; the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


class Memo(dict):
    """A bounded memo of ``fn``; it starts anew when ``limit`` entries are there, so memory stays bounded."""

    def __init__(self, fn, limit: int = 150_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


FILTER_BITS = 24


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of ``2 ** bits`` bits in which every key (a long) has set one: 2 MB, however many keys.

    It lets a scan leave out what a later exact join would drop; the fuller it is, the less it saves.
    """
    slot = F.pmod(F.col(column), F.lit(1 << bits))
    one = F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))")
    words = keys.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    found = np.zeros(1 << bits - 6, np.int64)
    for row in words:
        found[row["word"]] = row["bits"]
    return found


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bitmap."""
    slots = keys & (len(bits) * 64 - 1)
    return (bits[slots >> 6] >> (keys & 63)) & 1 == 1


WORD_HASHES = Memo(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit numbers (shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of word n-grams, ascending; a shorter text is one shingle, no words are none."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = word_hashes(words)
    span = min(width, len(words))
    rolled = np.zeros(len(words) - span + 1, np.uint64)
    for i in range(span):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + mix64(hashed[i : len(words) - span + 1 + i])
    # The length joins the hash, so a short text is no shingle of a longer one.
    return np.unique(mix64(rolled + np.uint64(span)))


def texts(batches: Iterator, column: str) -> Iterator[tuple]:
    """(record batch, list of its texts) of an Arrow batch iterator."""
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()
