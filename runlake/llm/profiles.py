"""Counts of one text that quality heuristics look at."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_letterless",
    "n_marks", "n_echoes",
)


@cache
def _kinds() -> np.ndarray:
    """Bits of every code point: 1 letter, 2 upper case, 4 symbol, 8 ASCII white space, 16 no letter, digit or space."""
    flags = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        flags[point] = c.isalpha() | c.isupper() << 1 | (not (c.isalnum() or c.isspace())) << 4
    for c in SYMBOLS:
        flags[ord(c)] |= 4
    for c in SPACES:
        flags[ord(c)] |= 8
    return flags


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words that stand in a window of ``width`` words which the text has twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for i in range(width):
        keys = (keys ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    repeated = np.zeros(n + width - 1, bool)
    found = np.zeros(n, bool)
    found[order[1:]] = same
    found[order[:-1]] |= same
    for i in range(width):
        repeated[i : i + n] |= found
    return int(repeated.sum())


def profile(text: str | None) -> tuple[int, ...]:
    """:data:`COUNTS` of a text; null is empty.

    A dup line has a word and equals an earlier line; a letterless word has no letter; marks are
    neither letters, digits nor space; an echo is a word that equals the one before it.
    """
    text = text or ""
    words = text.encode().split()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    flags = _kinds()[points]
    kinds = np.bincount(flags, minlength=32)
    bit = lambda b: int(sum(kinds[k] for k in range(32) if k & b))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    # A word begins where white space ends; it has a letter if the letters counted so far grow within it.
    space = (flags & 8).astype(bool)
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(points) else np.empty(0, np.int64)
    letters = np.add.reduceat((flags & 1).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    hashes = word_hashes(words)
    return (
        len(words), len(points) - bit(8), bit(4), len(lines) - len(set(lines)), repeated_words(hashes), len(lines), bit(1), bit(2),
        int((letters == 0).sum()), bit(16), int((hashes[1:] == hashes[:-1]).sum()),
    )


def profiled(text: str) -> Column:
    """A struct of :data:`COUNTS`, longs, of a text column."""

    @F.pandas_udf(", ".join(f"{name} bigint" for name in COUNTS))
    def counts(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profile(x) for x in found], columns=list(COUNTS), dtype="int64")

    return counts(F.col(text))
