import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from runlake.llm import periodic_runs, queries


def brute_runs(w):
    """Every maximal stretch of words q apart that are identical, twice q long or more, under its smallest q."""
    n, smallest = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                smallest.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, length, q) for (a, length), q in smallest.items())


def some_words(r):
    n, letters = r.randint(0, 45), "abcde"[: r.choice([1, 2, 2, 3, 5])]
    w = [r.choice(letters).encode() for _ in range(n)]
    if n and r.random() < 0.6:
        a, p = r.randrange(n), r.randint(1, 6)
        w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(150):
        docs = [some_words(r) for _ in range(r.randint(1, 5))]
        docs += [docs[0]]  # equal documents have nothing to do with each other
        assert periodic_runs.document_runs(docs, 2, 2) == [brute_runs(w) for w in docs]
        assert periodic_runs.document_runs(docs) == [[x for x in brute_runs(w) if x[1] >= max(6, 4 * x[2])] for w in docs]


def test_squares_are_all_and_only_the_branching_ones():
    r = random.Random(9)
    for _ in range(60):
        w = [r.choice([1, 2, 3]) for _ in range(r.randint(1, 40))]
        s = np.array([*w, 9])
        want = {(i, d) for d in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * d + 1) if w[i : i + d] == w[i + d : i + 2 * d] and s[i + d] != s[i + 2 * d]}
        assert set(zip(*(x.tolist() for x in periodic_runs.branching_squares(s)), strict=True)) == want


def test_suffix_array_is_sorted():
    r = random.Random(3)
    s = np.array([*(r.choice([1, 2]) for _ in range(300)), 7])
    sa, isa, lcp = periodic_runs.suffix_array(s)
    suffixes = [tuple(s[i:]) for i in sa]
    assert suffixes == sorted(suffixes) and all(isa[sa] == np.arange(len(s)))
    for k in range(1, len(s)):
        a, b = suffixes[k - 1], suffixes[k]
        assert lcp[k] == next(i for i in range(len(s)) if a[i] != b[i])


def test_one_word_all_over():
    """Half the length of squares end at one place; the smallest settles the rest."""
    assert periodic_runs.document_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]


def expected(i, text):
    """A row of op12, by definition."""
    w = (text or "").encode().split()
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = [x for x in brute_runs(w) if x[1] >= max(6, 4 * x[2])]
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    again = {k for a, length, q in found for k in range(a + q, a + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (
        i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{m},{q}\n" for a, m, q in found).encode()),
        digest(b" ".join(x for k, x in enumerate(w) if k not in again)),
    )


def test_query_equals_brute_force(ready, prose, tmp_path):
    r = random.Random(5)
    texts = [(i, " ".join(x.decode() for x in some_words(r)) + r.choice(["", " ", "\n", " x"])) for i in range(150)]
    texts += [(i, prose(i, r.choice([1, 3, 80]))) for i in range(150, 260)]
    texts += [(-5, "x " * 9 + "y z " * 8), (300, None), (301, ""), (302, " \t"), (None, "a " * 8), (None, None), (7, "b " * 6), (7, "b " * 6), (1 << 40, "ß é " * 5)]
    ready.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op12_periodic_runs"](ready, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected(*x) for x in texts), key=repr)


def test_odd_documents(odd_docs, no_docs):
    found = {r["doc_id"]: r for r in periodic_runs.collapsed(odd_docs).collect()}
    assert len(found) == 14 and periodic_runs.collapsed(odd_docs).columns == ["doc_id", "runs", "collapsed"]
    assert found[1]["runs"] == [] and found[1]["collapsed"] == "" and found[4]["collapsed"] == "one"
    assert periodic_runs.collapsed(odd_docs).count() == odd_docs.count()
    assert periodic_runs.collapsed(no_docs).count() == 0
    by_text = periodic_runs.collapsed(odd_docs, text="lang", key="text")  # any column names, a text key
    assert by_text.columns == ["text", "runs", "collapsed"] and by_text.count() == odd_docs.count()
