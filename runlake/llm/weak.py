"""Weak supervision: a label model of voters that may abstain.

Voters say +1 (good), -1 (bad) or 0 (abstain).  Expectation-maximisation over the counts of vote
patterns estimates how often each voter is right on good and on bad documents, and with that the
probability that a document with a pattern is good.  The patterns of ``k`` voters number at most
``3 ** k``, whatever the corpus, so they are all that reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_VOTERS = 9
# What the estimates are drawn to, by as many documents as PULL: most documents are good, a voter is mostly
# right on them, and finds some kinds of junk only.
PRIOR, GOOD, BAD, PULL = 0.8, 0.97, 0.4, 4.0


@dataclass(frozen=True)
class Bounds:
    """Where the estimates may lie, and how often voters are right on bad documents where the search starts.

    Without bounds of its own a voter is only no worse on good documents than a coin, and never quite sure.
    """

    least_on_good: float = 0.5
    most_on_good: float = 0.999
    most_on_bad: float = 0.999
    starts: tuple[float, ...] = (BAD, 0.6, 0.75, 0.9)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes; without a vote it is the prior."""
        good, bad = np.array(self.right_on_good), np.array(self.right_on_bad)
        weights = np.where(votes > 0, np.log(good / (1 - bad)), np.where(votes < 0, np.log((1 - good) / bad), 0.0))
        odds = np.log(self.prior / (1 - self.prior)) + weights.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, bounds: Bounds = Bounds(), rounds: int = 200) -> LabelModel:
    """EM over vote patterns and their numbers; without any pattern what the estimates are drawn to stays.

    Of several starts the one counts that explains the votes best.  A voter whose bad vote would speak
    for a document says nothing (``right_on_good + right_on_bad`` is 1 at least), so good and bad do
    not change places.
    """
    k = votes.shape[1]
    if not counts.sum():
        return LabelModel(PRIOR, (GOOD,) * k, (BAD,) * k)
    found = [_climbed(LabelModel(PRIOR, (GOOD,) * k, (bad,) * k), votes, counts, bounds, rounds) for bad in bounds.starts]
    return max(found, key=lambda model: _explained(model, votes, counts))


def _climbed(model: LabelModel, votes: np.ndarray, counts: np.ndarray, bounds: Bounds, rounds: int) -> LabelModel:
    """The model that EM reaches from ``model``."""
    cast, good_vote, bad_vote = votes != 0, votes > 0, votes < 0
    for _ in range(rounds):
        p = model.posterior(votes)
        good, bad = counts * p, counts * (1 - p)
        right_good = (good @ good_vote + PULL * GOOD) / (good @ cast + PULL)
        right_bad = (bad @ bad_vote + PULL * BAD) / (bad @ cast + PULL)
        right_good = np.clip(right_good, bounds.least_on_good, bounds.most_on_good)
        right_bad = np.clip(right_bad, np.minimum(1 - right_good, bounds.most_on_bad), bounds.most_on_bad)
        prior = float(np.clip((good.sum() + PULL * PRIOR) / (counts.sum() + PULL), 0.001, 0.999))
        new = LabelModel(prior, tuple(right_good.tolist()), tuple(right_bad.tolist()))
        if np.allclose(new.right_on_good + new.right_on_bad, model.right_on_good + model.right_on_bad, atol=1e-7):
            return new
        model = new
    return model


def _explained(model: LabelModel, votes: np.ndarray, counts: np.ndarray) -> float:
    """Log-likelihood of the votes, and of the documents that the estimates are drawn to."""
    good, bad = np.array(model.right_on_good), np.array(model.right_on_bad)
    as_good = np.log(model.prior) + ((votes > 0) * np.log(good) + (votes < 0) * np.log(1 - good)).sum(1)
    as_bad = np.log(1 - model.prior) + ((votes > 0) * np.log(1 - bad) + (votes < 0) * np.log(bad)).sum(1)
    drawn = PRIOR * np.log(model.prior) + (1 - PRIOR) * np.log(1 - model.prior)
    drawn += (GOOD * np.log(good) + (1 - GOOD) * np.log(1 - good) + BAD * np.log(bad) + (1 - BAD) * np.log(1 - bad)).sum()
    return float(counts @ np.logaddexp(as_good, as_bad) + PULL * drawn)


def pattern(votes: list[Column]) -> Column:
    """Votes as one number to base 3."""
    if len(votes) > MOST_VOTERS:
        raise ValueError(f"more than {MOST_VOTERS} voters make too many patterns for one driver table")
    return reduce(lambda number, vote: number * 3 + (vote + 1), votes, F.lit(0)).cast("int")


def unpacked(patterns: np.ndarray, k: int) -> np.ndarray:
    return np.stack([patterns // 3 ** (k - 1 - i) % 3 - 1 for i in range(k)], axis=1)


def vote(value: Column, good: Column, bad: Column) -> Column:
    """+1, -1, or 0 where neither holds or the value is null."""
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def learn(patterns: DataFrame, k: int, bounds: Bounds = Bounds()) -> tuple[LabelModel, list[float]]:
    """Fit on a frame with a ``pattern`` column; also the posterior of every possible pattern, by its number."""
    found = patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()
    numbers = np.array([r["pattern"] for r in found], np.int64)
    model = fit_label_model(unpacked(numbers, k), np.array([r["n"] for r in found], float), bounds)
    return model, model.posterior(unpacked(np.arange(3**k), k)).tolist()


def posterior_of(pattern_column: Column, posteriors: list[float]) -> Column:
    """Look the posterior up by pattern."""
    return F.element_at(F.array(*[F.lit(p) for p in posteriors]), pattern_column + 1)
