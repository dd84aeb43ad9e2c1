import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from runlake.llm import mixing, packing
from runlake.llm.queries import ORACLES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def reference_targets(sizes):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not capped:
            return target | {s: weight[s] * share for s in free}
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= capped
    return target


@pytest.fixture(scope="module")
def mix_docs(prose):
    r = random.Random(4)
    rows = [(i, prose(i, r.choice([1, 5, 30, 200])), r.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(400)]
    return [*rows, (500, None, "a"), (501, "", "z"), (3, "again one", "a"), (3, "again two", "a"), (None, "no id", None), (None, "no id", None), (502, "x", "\U0001f600"), (503, "y", "￿")]


def test_mix_equals_sql_and_meets_targets(ready, mix_docs, rows):
    frame = ready.createDataFrame(mix_docs, "doc_id bigint, text string, source string")
    found = rows(mixing.mixed_sizes(frame), "doc_id", "size", "source_size", "target", "times", "taken")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", mix_docs)
    assert found == sorted((tuple(r) for r in con.execute(ORACLES["op8_source_mix"]).fetchall()), key=repr)
    sizes, longest = {}, {}
    for _, t, s in mix_docs:
        n = len((t or "").split())
        sizes[s], longest[s] = sizes.get(s, 0) + n, max(longest.get(s, 0), n)
    targets = reference_targets(sizes)
    assert sorted({r[3] for r in found}) == pytest.approx(sorted(set(targets.values()))) and sum(targets.values()) == pytest.approx(sum(sizes.values()))
    mixed = mixing.mixed(frame).groupBy("source").agg({"text": "collect_list"}).collect()
    for s, texts in mixed:
        assert abs(sum(len(t.split()) for t in texts) - targets[s]) <= longest[s]
    assert all(r[4] <= 3 for r in found)


def test_a_single_huge_source_and_many_levels(ready, rows):
    """Equal hashes (one id) and one source: the group stands or falls together."""
    frame = ready.createDataFrame([(1, "a b", "s")] * 5 + [(2, "c", "t")], "doc_id bigint, text string, source string")
    found = rows(mixing.mixed_sizes(frame), "doc_id", "taken", "target")
    assert found[-1] == (2, 3, 3.0) and {r[:2] for r in found[:-1]} == {(1, 2)}


def test_odd_mix(odd_docs, no_docs):
    assert mixing.mixed_sizes(odd_docs).count() == odd_docs.count()
    assert mixing.mixed(odd_docs).columns == odd_docs.columns and mixing.mixed(odd_docs).count() > 0
    assert mixing.mixed_sizes(no_docs).count() == mixing.mixed(no_docs).count() == 0


def test_words_alone_give_the_ids_of_the_text(prose):
    t = Tokenizer.from_file(WORD_BPE)
    odd = ["it's I'm we'll. don't! O'Neil's.", "<|endoftext|>. a<|endoftext|>b , <|startoftext|>", "é́ éx. ΣΑΣ. ΣΑΣ, İstanbul. ﬁne.", "a\x1cb\x85c d\xa0e. １２３． ½.x.", "日本語。テスト.!? ...",
           "Ààé ÑÜß ÿŸ ǅ ĳ ŉ ſ K Å ªº Ø.  µ İ ĿL ÞÐ ÆŒ", "", " \n", "\U0001f600\U0001f600. x" * 3, "A" * 3000 + ",", prose(1, 500).title()]
    for text in odd:
        assert packing.tokenized(text, WORD_BPE) == np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(6))
def test_bins_are_full_and_whole(seed):
    r = random.Random(seed)
    counts = {r.randrange(1, 65): r.randrange(1, 30) for _ in range(r.randrange(1, 40))}
    plan = packing.bin_plan(counts, 64)
    used = {}
    for times, chosen in plan:
        assert sum(k * v for k, v in chosen.items()) <= 64
        for k, v in chosen.items():
            used[k] = used.get(k, 0) + times * v
    assert used == counts
    first_fit, bins = [], sum(t for t, _ in plan)
    for k in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        i = next((i for i, room in enumerate(first_fit) if room >= k), None)
        if i is None:
            first_fit.append(64 - k)
        else:
            first_fit[i] -= k
    assert -(-sum(k * n for k, n in counts.items()) // 64) <= bins <= len(first_fit)


def test_fullest_is_optimal():
    r = random.Random(8)
    for _ in range(60):
        counts = {r.randrange(1, 25): r.randrange(1, 4) for _ in range(5)}
        longest, sums = max(counts), {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1 - (k == longest))}
        chosen = packing.fullest(counts, 40)
        assert chosen[longest] >= 1 and all(v <= counts[k] for k, v in chosen.items())
        assert sum(k * v for k, v in chosen.items()) == longest + max(s for s in sums if s <= 40 - longest)


def check_packed(found, docs, capacity=2048):
    t, pieces, bins = Tokenizer.from_file(WORD_BPE), {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = []
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for n, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)
    return len(bins)


def test_odd_packing(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = packing.packed(odd_docs, WORD_BPE).collect()
    assert check_packed(found, docs) == -(-sum(r["length"] for r in found) // 2048)
    assert packing.packed(no_docs, WORD_BPE).count() == 0
