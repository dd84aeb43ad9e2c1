import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from runlake.llm import queries, repeated_passages as passages
from runlake.llm.repeated_passages import SPAN


def expected(docs):
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` by definition."""
    data = [(i, (t or "").encode()) for i, t in docs]
    starts = Counter(b[x : x + SPAN] for _, b in data for x in range(len(b) - SPAN + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b) + 1)
        for x in range(len(b) - SPAN + 1):
            if starts[b[x : x + SPAN]] > 1:
                gone[x : x + SPAN] = b"\1" * SPAN
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), len(b) - len(kept), sum(gone[k] > gone[k - 1] for k in range(len(b))), kept))
    return sorted(out, key=repr)


def found_rows(docs):
    return sorted(((r[0], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in passages.without_repeats(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def repeating_docs(prose):
    r = random.Random(6)
    passage = [prose(90 + k, 45) for k in range(6)]
    docs = [(i, prose(i, r.choice([20, 60, 200]))) for i in range(120)]
    for i in range(200, 300):  # passages amid own words, some cut by a few bytes, some next to each other
        middle = " ".join(r.choice(passage)[r.randint(0, 6) : r.choice([None, -1, 230, 260])] for _ in range(r.randint(1, 2)))
        docs.append((i, prose(i, r.choice([0, 30])) + " " + middle + " " + prose(i + 1000, r.choice([0, 30]))))
    docs += [(i, prose(i % 7, 80)) for i in range(300, 330)]  # copies
    near = prose(77, 150)
    docs += [(i, near[:k] + "#" + near[k:]) for i, k in enumerate(range(100, 900, 40), 400)]
    exact = prose(55, 60).encode()
    edge = lambda n: exact[:n].decode()
    docs += [(500, "left " + edge(199) + "x"), (501, "other" + edge(199) + "y"), (502, "Q" + edge(260)[60:] + "r"), (503, "P" + edge(261)[60:])]
    docs += [(510, "ab" * 300), (511, "|" * 700), (512, "é\U0001f600" * 90), (513, "x" + "é\U0001f600" * 90), (514, "a" * 199), (515, "b" * 200), (516, "c" * 201), (517, "\0" * 300 + "z")]
    docs += [(None, None), (None, ""), (518, None), (519, " "), (510, "ab" * 300), (None, prose(3, 60))]
    r.shuffle(docs)
    return docs


def test_removal_equals_brute_force(ready, repeating_docs):
    frame = ready.createDataFrame(repeating_docs, "doc_id bigint, text string").repartition(5)
    assert found_rows(frame) == expected(repeating_docs)


def test_small_ranges_runs_and_pieces(ready, repeating_docs, monkeypatch):
    """Many ranges, runs and pieces, as large inputs have."""
    pieces = [b for _, t in repeating_docs if len(b := (t or "").encode()) >= SPAN]
    monkeypatch.setattr(passages, "PIECE", 300)
    cut = [x for p, n, o in passages._pieces(_batches([p.decode() for p in pieces])) for x in zip(p, n, o, strict=True)]
    monkeypatch.setattr(passages, "PIECE", 1 << 22)
    windows = lambda ps: Counter((node, offset + x) for p, node, offset in ps for x in range(len(p) - SPAN + 1))
    whole = [x for p, n, o in passages._pieces(_batches([p.decode() for p in pieces])) for x in zip(p, n, o, strict=True)]
    assert windows(cut) == windows(whole) and max(len(p) for p, *_ in cut) < 300 + SPAN


def _batches(values):
    import pyarrow as pa

    return iter([pa.RecordBatch.from_arrays([pa.array(values)], names=["text"])])


def test_hot_heads(ready, repeating_docs, monkeypatch):
    """All repeated heads as hot ones: their windows go by digest, with the same result."""
    sent = passages._sent
    every = lambda docs, wanted, hot, parts: sent(docs, wanted, _heads(repeating_docs), 7)
    monkeypatch.setattr(passages, "_sent", every)
    frame = ready.createDataFrame(repeating_docs, "doc_id bigint, text string").repartition(4)
    assert found_rows(frame) == expected(repeating_docs)


def _heads(docs):
    heads = passages.anchors([(t or "").encode() for _, t in docs])[-1]
    return np.unique(heads)[::2]


def test_a_passage_in_a_third_of_all_documents(ready, prose):
    hot = prose(9999, 60)
    docs = [(i, f"{prose(i, 25)} {hot} {prose(-i, 25)}" if i % 3 == 0 else prose(i, 60)) for i in range(900)]
    rows = ready.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    counted = passages._counted_heads(rows.select("text"))
    assert counted.agg({"n": "max"}).first()[0] == 300
    assert found_rows(rows) == expected(docs)


def test_anchors_follow_from_windows(prose):
    """Equal windows have their anchors at the same offset, and every window has one anchor."""
    a, b = prose(1, 300).encode(), prose(2, 40).encode() + prose(1, 300).encode()[100:900] + prose(3, 60).encode()
    offsets = {}
    for k, data in enumerate((a, b)):
        piece, at, first, last, _ = passages.anchors([b"x" * 10, data])
        assert set(piece) == {1} and first[0] == 0 and last[-1] == len(data) - SPAN and all(first[1:] == last[:-1] + 1)
        for p, i, j in zip(at, first, last, strict=True):
            for x in range(i, j + 1):
                assert x <= p < x + passages.STARTS
                offsets.setdefault(data[x : x + SPAN], set()).add(int(p - x))
    assert all(len(x) == 1 for x in offsets.values()) and len(offsets) < len(a) + len(b) - 2 * SPAN


@pytest.mark.parametrize("seed", range(8))
def test_merge_of_front_coded_runs(seed):
    r = random.Random(seed)
    runs, every = [], []
    for k in range(r.choice([1, 2, 3, 5, 8])):
        own = sorted((bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), b"", bytes([k]), n) for n in range(r.randint(0, 40)))
        every += [x[0] for x in own]
        coded = passages.front_coded(own)
        runs.append([list(c) for c in zip(*coded, strict=True)] if coded else [[], [], [], [], []])
    which, place, sizes, shared = passages.merged(runs)
    texts = []
    for run in runs:
        last, own = b"", []
        for n, rest in zip(run[0], run[1], strict=True):
            last = last[:n] + rest
            own.append(last)
        texts.append(own)
    got = [texts[a][b] for a, b in zip(which, place, strict=True)]
    assert got == sorted(every) and [len(x) for x in got] == sizes
    assert shared[1:] == [passages.common(a, b) for a, b in zip(got, got[1:], strict=False)]


def test_merge_never_compares_known_prefixes(monkeypatch):
    """Bytes below the prefix that both contenders share with the last winner are not looked at again."""
    calls, whole = [], passages.common

    def spy(a, b, known=0):
        assert a[:known] == b[:known]
        calls.append(known)
        return whole(a, b, known)

    head = b"h" * 150
    runs = [[list(c) for c in zip(*passages.front_coded(sorted((head + bytes([x, y]), b"", b"", 0) for y in range(9) for x in (k, k + 3))), strict=True)] for k in range(4)]
    monkeypatch.setattr(passages, "common", spy)
    passages.merged(runs)
    assert calls.count(0) == 3 and min(c for c in calls if c) >= 150  # the first tournament alone starts at 0


def test_query(ready, repeating_docs, tmp_path):
    docs = [(i, t, None, "s", 1) for i, t in repeating_docs[:150]]
    ready.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_repeated_passages"](ready, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in expected([d[:2] for d in docs])]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_odd_documents(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found_rows(odd_docs) == expected(docs)
    assert passages.without_repeats(no_docs).count() == 0 and passages.spans(no_docs).count() == 0
    assert passages.without_repeats(odd_docs, text="lang", key="text").columns == ["text", "n_bytes", "n_removed", "n_spans", "kept"]
