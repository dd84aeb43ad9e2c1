import random
import re

import pytest
from pyspark.sql import functions as F

from runlake.llm import near_dedup as N
from runlake.llm.components import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(docs, width):
    sets = [(i, shingles(t, width)) for i, t in docs]
    low = list(range(len(sets)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                low[find(a)] = find(b)
    best = {}
    for n, (i, _) in enumerate(sets):
        best[find(n)] = min(best.get(find(n), i), i)
    return sorted((i, len(s), best[find(n)], best[find(n)] == i) for n, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(ready, prose, rows, width):
    r, docs = random.Random(width), []
    for group in range(25):
        words = prose(group, r.choice([12, 60, 150])).split()
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            copy = list(words)
            for _ in range(r.randrange(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(["x", "Y", "zz"]) + str(r.randrange(99))
            docs.append((len(docs), " ".join(copy)))
    docs += [(1000 + i, docs[0][1].upper()) for i in range(40)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "a b c")]
    found = N.near_duplicates(ready.createDataFrame(docs, "doc_id bigint, text string"), width=width)
    assert rows(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(docs, width), key=repr)


def test_one_large_group_of_near_copies_in_blocks(ready, prose, rows, monkeypatch):
    monkeypatch.setattr(N, "FEW_SHINGLES", 1000)
    monkeypatch.setattr(N, "MANY_SHINGLES", 3000)
    r, words, docs = random.Random(1), prose(9, 150).split(), []
    for i in range(120):
        copy = list(words)
        for _ in range(r.randrange(0, 9)):
            copy[r.randrange(150)] = f"e{r.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    found = rows(N.near_duplicates(ready.createDataFrame(docs, "doc_id bigint, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(brute(docs, 5), key=repr)


def test_odd_rows(odd_docs, no_docs, rows):
    found = rows(N.near_duplicates(odd_docs), "doc_id", "n_shingles", "component_id", "kept")
    assert len(found) == odd_docs.count()
    by = {}
    for i, n, c, k in found:
        by.setdefault(i, []).append((n, c, k))
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[7][0][1:] == (6, False) and by[13][0][1:] == (12, False)
    assert (0, None, True) in by[None]  # a null key and no shingles
    assert sorted(c for _, c, _ in by[8]) == [8, 8, 8]  # a null key does not lower a component
    kept = N.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [t for (t,) in rows(kept, "text")]
    assert len(texts) == 17 - 1 - 2 - 1  # the long copy, two copies of text 2, the near copy
    assert texts.count("") == 1 and texts.count(None) == 2
    for empty in (N.near_duplicates(no_docs), N.deduplicated(no_docs)):
        assert empty.count() == 0


def test_components(ready):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 501), (501, 500), (7, 7)]
    found = components(ready.createDataFrame(edges, "u bigint, v bigint")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len({roots[i] for i in range(41)}) == 1 and len({roots[100 + i] for i in range(50)}) == 1
    assert roots[500] == roots[501] and len(set(roots.values())) == 3


def test_few_links_share_no_table():
    assert N.missed(0.8) < 5e-4 and N.missed(0.9) < 1e-6


def test_no_all_pairs(ready, prose):
    """Copies of one text and of its variants send rows in proportion to their number."""
    texts = [prose(1, 80), prose(1, 80) + " more"]
    docs = ready.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("text"))
    found = N.near_duplicates(docs)
    assert found.where("component_id = 0").count() == 3000
