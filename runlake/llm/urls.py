"""URL filter on a sorted digest array.

The rules (host and path prefix with a verdict) are one file: 64-bit xxhash keys in ascending order,
string offsets, verdicts, and the full rule strings.  Executors receive it once, map it into memory
and probe a whole batch of candidates by one vectorised binary search; a hit counts only if the
stored string is the candidate itself.  Mapped pages are shared by all workers of a machine and take
no heap, so the list may be long; it is sized by the rules, never by the pages.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

VERDICTS = ("allow", "block")
PARTS = r"://([^/?#]*)([^?#]*)"


def write_rules(rules: Iterable[tuple[str, str]], file: str) -> None:
    """Write ``(rule, verdict)`` pairs as a digest file; a rule is a host and a path prefix, ``net/es/``.

    A rule given twice keeps its last verdict.
    """
    verdicts = {rule.encode(): VERDICTS.index(verdict) for rule, verdict in rules}
    order = sorted((xxhash.xxh64_intdigest(rule), rule) for rule in verdicts)
    starts = np.cumsum([0, *(len(rule) for _, rule in order)])
    # Distinct path lengths tell which prefixes of a path are worth a probe.
    lengths = np.unique([len(rule) - rule.index(b"/") if b"/" in rule else 0 for rule in verdicts]).astype(np.int64)
    with open(file, "wb") as out:
        np.array([len(order), len(lengths)], np.int64).tofile(out)
        lengths.tofile(out)
        np.array([key for key, _ in order], np.uint64).tofile(out)
        starts.astype(np.int64).tofile(out)
        np.array([verdicts[rule] for _, rule in order], np.uint8).tofile(out)
        out.write(b"".join(rule for _, rule in order))


class Rules:
    """A digest file mapped into memory."""

    def __init__(self, file: str):
        n, k = np.fromfile(file, np.int64, 2)
        self.lengths = np.fromfile(file, np.int64, k, offset=16)
        at = 16 + 8 * k
        self.keys = _mapped(file, np.uint64, at, n)
        self.starts = _mapped(file, np.int64, at + 8 * n, n + 1)
        self.verdicts = _mapped(file, np.uint8, at + 16 * n + 8, n)
        self.strings = _mapped(file, np.uint8, at + 17 * n + 8, os.path.getsize(file) - (at + 17 * n + 8))

    def candidates(self, host: bytes, path: bytes) -> Iterator[bytes]:
        """Every host suffix with every path prefix of a length that some rule has."""
        prefixes = [path[:n] for n in self.lengths.tolist() if n <= len(path)]
        while host:
            for prefix in prefixes:
                yield host + prefix
            host = host.partition(b".")[2]

    def find(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The longest rule that fits each url and its verdict, ``(None, None)`` without any.

        Of rules of equal length that with the longer host counts.
        """
        owner, tried = [], []
        for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for candidate in self.candidates(host.encode(), path.encode()):
                owner.append(row)
                tried.append(candidate)
        found: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        if not tried or not len(self.keys):
            return found
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, tried), np.uint64, len(tried))
        at = np.searchsorted(self.keys, wanted)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        best = [-1] * len(hosts)
        for i in hit.tolist():
            entry = self._confirmed(int(at[i]), wanted[i], tried[i])
            if entry is not None and len(tried[i]) > best[owner[i]]:
                best[owner[i]] = len(tried[i])
                found[owner[i]] = (tried[i].decode(), VERDICTS[self.verdicts[entry]])
        return found

    def _confirmed(self, at: int, key: np.uint64, candidate: bytes) -> int | None:
        """The entry that stores the very string; entries of equal keys stand side by side."""
        while at < len(self.keys) and self.keys[at] == key:
            if self.strings[self.starts[at] : self.starts[at + 1]].tobytes() == candidate:
                return at
            at += 1
        return None


def _mapped(file: str, kind: type, at: int, n: int) -> np.ndarray:
    return np.memmap(file, kind, "r", int(at), (int(n),)) if n else np.empty(0, kind)


@lru_cache(maxsize=4)
def _rules(name: str) -> Rules:
    return Rules(SparkFiles.get(name))


def url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """The frame with ``host`` and ``path``; both empty where the url is null or has no ``://``.

    Fragments, queries and a missing path are left out; only A-Z are lower-cased.
    """
    host, path = (F.coalesce(F.regexp_extract(url, PARTS, i), F.lit("")) for i in (1, 2))
    return urls.withColumns({"host": ascii_lower(host), "path": path})


def judged(spark: SparkSession, urls: DataFrame, rules: Iterable[tuple[str, str]], url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row.

    A rule fits its host and all its subdomains if the url's path starts with the rule's; the longest
    counts.  Without a fitting rule the url is not on the list: ``rule`` is null and the verdict
    ``default``.  Rows are judged one by one, so null, empty and repeated ones need no care.
    """
    folder = tempfile.mkdtemp(prefix="rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"rules-{uuid.uuid4().hex[:12]}.bin"
    write_rules(rules, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")  # served by the driver to every executor
    key_type = urls.schema[key].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _rules(name)
        for batch in batches:
            found = index.find(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x or default for _, x in found], pa.string())],
                names=["key", "host", "path", "rule", "verdict"],
            )

    parts = url_parts(urls.select(F.col(key).alias("key"), F.col(url).alias("url"))).select("key", "host", "path")
    return parts.mapInArrow(probe, f"key {key_type}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
