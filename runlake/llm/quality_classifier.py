"""Quality classifier trained on weak labels.

Heuristic labellers look at overlapping traits; a label model estimates by expectation-maximisation
over the votes of all documents how far each is right; the posteriors label a bounded sample, and a
linear scorer over hashed features learns from it.  The scorer sees word shapes and coarse traits, so
it also judges documents on which the labellers abstain.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash60
from .profiles import COUNTS, profile, profiled
from .weak import BAD, Bounds, learn, pattern, posterior_of, vote

SLOTS = 1 << 14
# The only bounded sample: the documents of lowest hash, about this many, train the scorer.
TRAIN_ROWS = 12_000
KEEP_FROM = 0.5
# Shares of a shorter text say nothing: all labellers abstain.
LEAST_VOTED = 20
# The labellers see different kinds of junk, so a good vote must not clear junk of a kind that its labeller does not see.
# With free bounds the label model takes the largest kinds for all of junk and calls the others good.
BOUNDS = Bounds(0.98, 0.99, 0.5, starts=(BAD,))
STEPS, BATCH, RATE, DECAY = 600, 256, 0.3, 1e-5


def labellers(p: Column) -> list[Column]:
    """Overlapping votes on a profile of :data:`COUNTS`."""
    share = lambda part, whole: F.when(p["n_words"] >= LEAST_VOTED, p[part] / F.when(p[whole] > 0, p[whole]))
    symbols, dense = share("n_symbols", "n_words"), share("n_symbols", "word_chars")
    letters, upper = share("n_letters", "word_chars"), share("n_upper", "n_letters")
    letterless, echoes = share("n_letterless", "n_words"), share("n_echoes", "n_words")
    marks, lines = share("n_marks", "word_chars"), F.when(p["n_lines"] >= 4, share("n_dup_lines", "n_lines"))
    repeats = share("n_repeat_words", "n_words")
    return [
        vote(symbols, symbols < 0.02, symbols > 0.3),
        vote(dense, dense < 0.005, dense > 0.08),
        vote(letters, letters > 0.92, letters < 0.7),
        vote(upper, upper < 0.1, upper > 0.5),
        vote(letterless, letterless < 0.05, letterless > 0.3),
        vote(repeats, repeats < 0.1, repeats > 0.5),
        vote(echoes, echoes < 0.03, echoes > 0.25),
        vote(lines, lines < 0.05, lines > 0.4),
        vote(marks, marks < 0.07, marks > 0.18),
    ]


def _shape(shape: bytes) -> int:
    """Slot of a word's shape."""
    return xxhash.xxh3_64_intdigest(b"shape " + shape[:24]) % SLOTS


SHAPES = Memo(_shape, 100_000)
# Upper-case ASCII letters are A, digits 0, lower-case and all other letters a; other characters stay.
KINDS = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))


def shapes(text: str) -> list[bytes]:
    """Shapes of a text's words: kinds of characters, each run of one kind once."""
    kinds = np.frombuffer(text.encode().translate(KINDS), np.uint8)
    return kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))].tobytes().split() if len(kinds) else []


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots and values: shares of word shapes, and steps of traits."""
    text = text or ""
    slots: Counter[int] = Counter()
    found = Counter(shapes(text))
    for shape, n in found.items():
        slots[SHAPES[shape]] += n / found.total()
    p = dict(zip(COUNTS, profile(text), strict=True))
    share = lambda part, whole: p[part] / p[whole] if p[whole] else 0.0
    traits = {
        "repeats": share("n_repeat_words", "n_words"), "echoes": share("n_echoes", "n_words"), "marks": share("n_marks", "word_chars"),
        "lines": share("n_dup_lines", "n_lines") if p["n_lines"] >= 4 else 0.0, "letters": 1 - share("n_letters", "word_chars"),
        "upper": share("n_upper", "n_letters"), "symbols": min(1.0, share("n_symbols", "n_words")), "letterless": share("n_letterless", "n_words"),
    }
    for name, value in traits.items() if p["n_words"] >= LEAST_VOTED else ():
        # One feature for each tenth that the share reaches, so weights add up along the share.
        for step in range(1, int(value * 10) + 1):
            slots[xxhash.xxh3_64_intdigest(f"{name} {step}".encode()) % SLOTS] += 0.3
    slots[xxhash.xxh3_64_intdigest(b"bias") % SLOTS] += 1.0
    return np.fromiter(slots, np.int32, len(slots)), np.fromiter(slots.values(), np.float32, len(slots))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], seed: int = 7) -> np.ndarray:
    """Logistic weights for posterior labels by averaged stochastic gradient steps; no rows give zeros."""
    weights, squares, total = np.zeros(SLOTS), np.full(SLOTS, 1e-6), np.zeros(SLOTS)
    random, order = np.random.default_rng(seed), np.empty(0, np.int64)
    for step in range(STEPS if rows else 0):
        if len(order) < min(BATCH, len(rows)):
            order = random.permutation(len(rows))
        picked, order = [rows[i] for i in order[:BATCH]], order[BATCH:]
        sizes = [len(s) for s, _, _ in picked]
        slots, values = np.concatenate([s for s, _, _ in picked]), np.concatenate([v for _, v, _ in picked])
        owner = np.repeat(np.arange(len(picked)), sizes)
        z = np.bincount(owner, weights[slots] * values, len(picked))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([y for _, _, y in picked])
        gradient = np.bincount(slots, error[owner] * values, SLOTS) / len(picked) + DECAY * weights
        squares += gradient**2
        weights -= RATE * gradient / np.sqrt(squares)
        if step >= STEPS // 2:
            total += weights
    return total / max(STEPS - STEPS // 2, 1)


def score_of(weights: np.ndarray) -> Callable[[str | None], float]:
    def score(text: str | None) -> float:
        slots, values = features(text)
        return float(1 / (1 + np.exp(-np.clip(weights[slots] @ values, -30, 30))))

    return score


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the scorer.

    The label model sees the votes of all documents; features of at most about ``train_rows`` come to
    the driver.  The sample is drawn by a hash of the key, or of the text where the key is null.
    """
    p = F.col("_profile")
    drawn = hash60(F.concat(F.lit("train:"), F.coalesce(F.col(key).cast("string"), F.col(text), F.lit(""))))
    voted = docs.select(profiled(text).alias("_profile")).select(pattern(labellers(p)).alias("pattern"))
    _, posteriors = learn(voted, len(labellers(p)), BOUNDS)
    part = min(1.0, train_rows / max(docs.count(), 1))

    @F.pandas_udf("slots array<int>, vals array<float>")
    def hashed(found: pd.Series) -> pd.DataFrame:
        rows = [features(x) for x in found]
        return pd.DataFrame({"slots": [s for s, _ in rows], "vals": [v for _, v in rows]})

    sample = docs.where(drawn < F.lit(int(part * (1 << 60)))).select(F.col(text).alias("_text"))
    sample = sample.select(profiled("_text").alias("_profile"), hashed(F.col("_text")).alias("_features"))
    label = posterior_of(pattern(labellers(p)), posteriors)
    found = sample.select("_features.slots", "_features.vals", label.alias("label")).toArrow().to_pylist()
    found.sort(key=lambda r: (r["slots"], r["label"]))  # so that a rerun meets the rows in the same order
    return train([(np.array(r["slots"], np.int32), np.array(r["vals"], np.float32), r["label"]) for r in found])


def scored(text: str, weights: np.ndarray) -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(found: pd.Series) -> pd.Series:
        one = score_of(weights)
        return pd.Series([one(x) for x in found], dtype="float64")

    return score(F.col(text))


def classified(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document ``key, score, kept``: kept from a score of 0.5.

    Null and empty texts have only the bias feature and so the score of a document that shows no bad
    trait.  Repeated rows score alike, a null key stays null, an empty table gives no rows.
    """
    weights = fit(docs, text, key, train_rows)
    found = docs.select(key, scored(text, weights).alias("score"))
    return found.withColumn("kept", F.col("score") >= KEEP_FROM)


def kept(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier keeps, all columns."""
    weights = fit(docs, text, key, train_rows)
    found = docs.select(F.struct("*").alias("_doc"), scored(text, weights).alias("_score"))
    return found.where(F.col("_score") >= KEEP_FROM).select("_doc.*")
