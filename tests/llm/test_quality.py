import collections
import random
import re

import numpy as np
import pytest

from runlake.llm import quality_classifier, quality_rules, weak
from runlake.llm.profiles import COUNTS, profile


def counted(text):
    """The base counts by definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


def junk(prose, kind, i):
    words = prose(i, 150).split()
    return {
        "symbols": " ".join(w + "&&&" for w in words), "shout": " ".join(w.upper() + "!!" for w in words), "cells": " | ".join(words),
        "repeats": " ".join(w for w in words[:8] for _ in range(20)), "lines": "\n".join([" ".join(words[:9])] * 20),
    }[kind]


KINDS = ("symbols", "shout", "cells", "repeats", "lines")


@pytest.fixture(scope="module")
def labelled(ready, prose):
    rows = [(i, prose(i, 60 + i % 200), 1) for i in range(400)] + [(1000 + i, junk(prose, KINDS[i % 5], i), 0) for i in range(80)]
    return ready.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_profile_by_definition():
    r = random.Random(3)
    texts = [None, "", " ", "a", "\n\n", "a a a a", "x\x1cy \x85z\n  \nx", "#|*<> a\na\na \n a"]
    texts += ["".join(r.choice(["a", "b", " ", "\n", "B", "#", "é", "\t", "1"]) for _ in range(r.randrange(120))) for _ in range(300)]
    for text in texts:
        p = profile(text)
        assert p[:5] == counted(text), text
        assert p[COUNTS.index("n_letterless")] == sum(not any(c.isalpha() for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_shapes():
    assert quality_classifier.shapes("The\tCAT's \u00c9t\u00e9, 1234-5!!!\n\n|") == [b"Aa", b"A'a", b"a,", b"0-0!", b"|"]
    assert quality_classifier.shapes("") == quality_classifier.shapes(" \n") == []


def drawn_votes(truth, right_good, right_bad, cast, seed):
    r = np.random.default_rng(seed)
    n = len(truth)
    votes = np.stack([np.where(r.random(n) < np.where(truth, g, b), np.where(truth, 1, -1), np.where(truth, -1, 1)) for g, b in zip(right_good, right_bad, strict=True)], 1)
    votes[r.random(votes.shape) >= cast] = 0
    return votes


@pytest.mark.parametrize(("right_good", "right_bad", "prior"), [
    ((0.99, 0.98, 0.70, 0.95), (0.90, 0.85, 0.80, 0.60), 0.8),
    ((0.95, 0.90, 0.85, 0.99, 0.55), (0.90, 0.80, 0.75, 0.60, 0.55), 0.7),
    ((0.97, 0.98, 0.60, 0.90, 0.95), (0.70, 0.95, 0.60, 0.75, 0.55), 0.9),
])
def test_label_model_finds_careless_voters(right_good, right_bad, prior):
    truth = np.random.default_rng(4).random(40_000) < prior
    votes = drawn_votes(truth, right_good, right_bad, 0.8, 5)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit_label_model(patterns, counts.astype(float))
    assert model.prior == pytest.approx(prior, abs=0.05)
    assert model.right_on_good == pytest.approx(right_good, abs=0.05) and model.right_on_bad == pytest.approx(right_bad, abs=0.05)
    best = weak.LabelModel(prior, right_good, right_bad).posterior(votes) >= 0.5
    found = model.posterior(votes) >= 0.5
    assert (truth & ~found).sum() < (truth & ~best).sum() + 0.01 * truth.sum() and (found == truth).mean() > (best == truth).mean() - 0.005


def test_label_model_climbs_and_keeps_its_bounds():
    truth = np.random.default_rng(6).random(5_000) < 0.8
    patterns, counts = np.unique(drawn_votes(truth, (0.9, 0.8, 0.95), (0.8, 0.7, 0.6), 0.9, 7), axis=0, return_counts=True)
    counts = counts.astype(float)
    start = weak.LabelModel(0.8, (0.97,) * 3, (0.6,) * 3)
    steps = [weak._explained(weak._climbed(start, patterns, counts, weak.Bounds(), rounds), patterns, counts) for rounds in (1, 2, 5, 20, 100)]
    assert steps == sorted(steps)
    # The posterior by definition.
    model = weak.fit_label_model(patterns, counts)
    for votes, p in zip(patterns, model.posterior(patterns), strict=True):
        good, bad = model.prior, 1 - model.prior
        for v, g, b in zip(votes, model.right_on_good, model.right_on_bad, strict=True):
            good, bad = good * (g if v > 0 else 1 - g if v < 0 else 1), bad * (1 - b if v > 0 else b if v < 0 else 1)
        assert p == pytest.approx(good / (good + bad))
    bounded = weak.fit_label_model(patterns, counts, weak.Bounds(0.98, 0.99, 0.5))
    assert min(bounded.right_on_good) >= 0.98 and max(bounded.right_on_good) <= 0.99 and max(bounded.right_on_bad) <= 0.5
    # A voter that is always wrong is no voter, and does not turn good and bad around.
    turned = patterns.copy()
    turned[:, 2] *= -1
    assert weak.fit_label_model(turned, counts).right_on_good[2] >= 0.5


def test_label_model_finds_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.8
    right_good, right_bad = [0.985, 0.98, 0.99, 0.988], [0.5, 0.45, 0.3, 0.48]
    votes = np.stack([np.where(r.random(20_000) < np.where(truth, g, b), np.where(truth, 1, -1), np.where(truth, -1, 1)) for g, b in zip(right_good, right_bad, strict=True)], 1)
    votes[r.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit_label_model(patterns, counts.astype(float))
    assert model.prior == pytest.approx(truth.mean(), abs=0.03)
    assert model.right_on_good == pytest.approx(right_good, abs=0.04) and model.right_on_bad == pytest.approx(right_bad, abs=0.1)
    best = weak.LabelModel(0.8, tuple(right_good), tuple(right_bad)).posterior(votes)
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > ((best >= 0.5) == truth).mean() - 0.01
    assert weak.fit_label_model(np.zeros((0, 3), int), np.zeros(0)).prior == weak.PRIOR
    numbers = np.arange(27)
    assert (((weak.unpacked(numbers, 3) + 1) * [9, 3, 1]).sum(1) == numbers).all()


def plain_votes(text):
    p = dict(zip(COUNTS, profile(text), strict=True))
    if p["n_words"] < 20:
        return [0] * 9

    def one(part, whole, good, bad):
        if not p[whole]:
            return 0
        share = p[part] / p[whole]
        return -1 if bad(share) else int(good(share))

    return [
        one("n_symbols", "n_words", lambda x: x < 0.02, lambda x: x > 0.2), one("n_repeat_words", "n_words", lambda x: x < 0.15, lambda x: x > 0.4),
        one("n_dup_lines", "n_lines", lambda x: x < 0.1, lambda x: x > 0.3) if p["n_lines"] >= 4 else 0,
        one("word_chars", "n_words", lambda x: 3.5 <= x <= 9, lambda x: x < 2.5 or x > 14),
        one("n_letters", "word_chars", lambda x: x > 0.9, lambda x: x < 0.75), one("n_upper", "n_letters", lambda x: x < 0.12, lambda x: x > 0.4),
        one("n_echoes", "n_words", lambda x: x < 0.05, lambda x: x > 0.2), one("n_letterless", "n_words", lambda x: x < 0.08, lambda x: x > 0.25),
        one("n_marks", "word_chars", lambda x: x < 0.08, lambda x: x > 0.15),
    ]


def test_rules_tell_junk_from_prose(labelled):
    found = {r["doc_id"]: r for r in quality_rules.judged(labelled).collect()}
    for i, text, quality in labelled.collect():
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(text)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)
        assert r["kept"] == bool(quality), (i, text[:60])
    kept, model = quality_rules.kept(labelled)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in found.items() if r["kept"])
    # The posteriors by definition, from votes written out here.
    texts = [(i, text) for i, text, _ in labelled.collect()]
    votes = np.array([plain_votes(text) for _, text in texts])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    plain = weak.fit_label_model(patterns, counts.astype(float))
    assert plain.right_on_good == pytest.approx(model.right_on_good, abs=1e-6) and plain.right_on_bad == pytest.approx(model.right_on_bad, abs=1e-6)
    for (i, _), p in zip(texts, plain.posterior(votes), strict=True):
        assert found[i]["posterior"] == pytest.approx(p, abs=1e-6)


def test_one_failed_rule_need_not_reject(ready, prose):
    """A clean text with a single odd trait stays: votes are weighed."""
    rows = [(i, prose(i, 150), 1) for i in range(300)] + [(1000 + i, junk(prose, KINDS[i % 5], i), 0) for i in range(60)]
    rows.append((5000, "\n".join([prose(7, 100)] + ["Read on"] * 5), 1))
    found = {r["doc_id"]: r for r in quality_rules.judged(ready.createDataFrame(rows, "doc_id bigint, text string, quality int")).collect()}
    assert found[5000]["n_dup_lines"] == 4 and found[5000]["kept"]


def test_classifier_tells_junk_from_prose(labelled):
    found = {r["doc_id"]: r for r in quality_classifier.classified(labelled).collect()}
    wrong = [i for i, _, quality in labelled.collect() if found[i]["kept"] != bool(quality)]
    assert len(wrong) <= 4, wrong
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in found.values())
    # Fitting on a part of the rows, and fitting again, changes little or nothing.
    again = {r["doc_id"]: r["score"] for r in quality_classifier.classified(labelled).collect()}
    assert max(abs(again[i] - r["score"]) for i, r in found.items()) < 1e-9
    few = {r["doc_id"]: r["kept"] for r in quality_classifier.classified(labelled, train_rows=150).collect()}
    assert sum(few[i] != r["kept"] for i, r in found.items()) <= 20
    assert quality_classifier.kept(labelled).count() == sum(r["kept"] for r in found.values())


def test_odd_rows(odd_docs, no_docs):
    rules = quality_rules.judged(odd_docs).collect()
    assert len(rules) == 17 and all(r["base_failed"] and not r["kept"] for r in rules if r["doc_id"] in (1, 2, 3, 4, 5, 10, 11))
    assert any(r["kept"] for r in rules if r["doc_id"] == 6)
    kept = quality_rules.kept(odd_docs)[0]
    assert kept.columns == odd_docs.columns and kept.count() == sum(r["kept"] for r in rules)
    scores = quality_classifier.classified(odd_docs).collect()
    assert len(scores) == 17 and len({r["score"] for r in scores if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality_classifier.kept(odd_docs).columns == odd_docs.columns
    for empty in (quality_rules.judged(no_docs), quality_rules.kept(no_docs)[0], quality_classifier.classified(no_docs), quality_classifier.kept(no_docs)):
        assert empty.count() == 0
