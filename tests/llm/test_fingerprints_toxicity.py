import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runlake.llm import fingerprints as P
from runlake.llm import toxicity as T


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), seed=h)
    return signed(h)


def all_hashes(text, width=5):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return sorted({hashed(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}) if words else []


def likeness(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def shown(a):
    return ",".join(f"{x & (2**64 - 1):X}" for x in a)


def test_fingerprints_by_brute_force(odd_docs, rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 2)
    monkeypatch.setattr(P, "QUANTILES", 3)
    docs = sorted(((i, t or "") for i, t in rows(odd_docs, "doc_id", "text")), key=lambda d: (d[0] is not None, d[0] or 0, d[1].encode()))
    want = []
    for n, (i, t) in enumerate(docs):
        following, half = docs[(n + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = (all_hashes(x)[:128] for x in (t, edited, following))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b, 128), likeness(a, c, 128)))
    found = rows(P.fingerprinted(odd_docs), "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert found == sorted(want, key=repr)


@pytest.mark.parametrize("ids", [[1, 2, 3, 10**15, 10**15 + 1], [-5, 7, 7, 7, 8], [4], list(range(0, 3000, 7))])
def test_next_texts_across_buckets(ready, ids, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 5)
    monkeypatch.setattr(P, "QUANTILES", 4)
    frame = ready.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    found = sorted((r["_key"], r["_text"], r["_next"]) for r in P.with_next(frame).where("NOT _sentinel").collect())
    order = sorted((i, f"t{n}") for n, i in enumerate(ids))
    assert found == [(i, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)]


def test_sketches_merge_and_estimate(ready, prose):
    words = prose(1, 4000).split()
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    frame = ready.createDataFrame([(a, b, " ".join(words))], "a string, b string, whole string").select(*[P.sketch(F.col(c)).alias(c) for c in ("a", "b", "whole")])
    r = frame.select(
        P.resemblance(F.col("a"), F.col("b")).alias("j"), P.containment(F.col("a"), F.col("whole")).alias("c"), P.distinct_shingles(F.col("a")).alias("n"),
    ).first()
    x, y = set(all_hashes(a)), set(all_hashes(b))
    assert r["j"] == pytest.approx(len(x & y) / len(x | y), abs=0.15) and r["c"] == pytest.approx(1, abs=0.2) and r["n"] == pytest.approx(len(x), rel=0.3)
    parts = [(g, " ".join(words[i : i + 300])) for g in (1, 2) for i in range(0, 4000, 200)] + [(3, ""), (3, None)]
    sketches = ready.createDataFrame(parts, "g int, text string").select("g", P.sketch(F.col("text")).alias("sketch"))
    found = {r["g"]: r["sketch"] for r in P.merged_groups(sketches, ["g"]).collect()}
    whole = sorted({h for g, t in parts if g == 1 for h in all_hashes(t)})[:128]
    assert found == {1: whole, 2: whole, 3: []}


def test_no_docs_no_fingerprints(no_docs):
    assert P.fingerprinted(no_docs).count() == 0


@pytest.fixture(scope="module")
def insults(ready, prose):
    r, rows = random.Random(6), []
    for i in range(900):
        words, toxic = prose(i, r.choice([20, 60, 400])).split(), int(i % 6 == 0)
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["Moron", "scum,", "IDIOT!", "you fool"]))
        rows.append((i, " ".join(words), toxic, f"s{toxic}"))
    docs = ready.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id bigint, text string, source string")
    labels = ready.createDataFrame([(i, x) for i, _, x, _ in rows], "doc_id bigint, toxic int")
    return docs, labels, {i: x for i, _, x, _ in rows}


def test_held_out_accuracy(insults, rows):
    docs, labels, truth = insults
    found = rows(T.scored(docs, labels), "doc_id", "held_out", "score", "predicted")
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) and p == int(s >= 0.7) and 0 <= s <= 1 for i, held, s, p in found)
    held = [(truth[i], p) for i, h, _, p in found if h]
    assert sum(p for x, p in held if x) >= 0.9 * sum(x for x, _ in held) and sum(p for x, p in held if not x) <= 0.02 * len(held)
    # Labels of held-out rows are never looked at.
    hidden = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows(T.scored(docs, hidden), "doc_id", "held_out", "score", "predicted") == found
    # A table too large to hand out, and labels too many to broadcast, give the same scores.
    joined = {r["doc_id"]: r["score"] for r in T.scored(docs, labels, model_rows=-1, label_rows=-1).collect()}
    assert max(abs(joined[i] - s) for i, _, s, _ in found) < 1e-9


def test_odd_documents_and_labels(ready, odd_docs, no_docs, insults, rows):
    docs, labels, _ = insults
    with_odd = docs.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    odd_labels = labels.union(ready.createDataFrame([(None, 1), (7, None), (10**6, 1), (3, 0)], "doc_id bigint, toxic int"))
    found = T.scored(with_odd, odd_labels).collect()
    assert len(found) == 917 and all(r["predicted"] in (0, 1) for r in found)
    assert all(r["held_out"] is False for r in found if r["doc_id"] is None)
    none = labels.limit(0)
    assert {(r["predicted"], r["score"] < 0.01) for r in T.scored(odd_docs, none).collect()} == {(0, True)}
    assert len(T.scored(odd_docs, odd_labels.where("toxic = 0")).collect()) == 17
    assert T.scored(no_docs, labels).count() == T.scored(no_docs, none).count() == 0


def test_block_means_by_definition():
    r = np.random.default_rng(2)
    for n in (1, 15, 16, 63, 64, 65, 500):
        x = r.normal(size=n)
        blocks = [x[i : i + T.BLOCK] for i in range(0, n, T.BLOCK)]
        want = max(b.sum() / max(len(b), T.LEAST_BLOCK) for b in blocks), x.sum() / max(n, T.LEAST_BLOCK)
        assert T.block_means(x) == pytest.approx(want)


def test_rare_toxic_pairs_count_whatever_the_size(ready):
    texts = [(f"you are fool{i % 50} x{i % 7}", 1, i % 2) for i in range(3000)] + [(f"a wet{i % 5} paper bag", 0, i % 2) for i in range(300)]
    texts += [("soggy paper", 1, i % 2) for i in range(5)] + [(w, 0, i % 2) for i in range(50) for w in ("soggy", "fine paper")]
    model = {r["key"] for r in T.scoring_table(ready.createDataFrame(texts, "text string, toxic int, half int")).collect()}
    assert int(T.pair_keys(T.tokens("soggy paper"))[0]) in model


def test_both_classes_have_pairs_of_their_own(ready):
    texts = [("wet paper", 1, 0), ("wet stone", 1, 1)] * 4 + [(f"wet {w}", 0, i % 2) for i in range(40) for w in ("stone", "leaf")]
    texts += [(f"dry {w}", x, i % 2) for i in range(20) for x, w in ((1, "leaf"), (0, "paper"))]
    frame = ready.createDataFrame(texts, "text string, toxic int, half int")
    of = lambda text: tuple(int(x) for x in T.tokens(text))
    counts = {(r["v"], r["w"]): r.asDict() for r in T._gathered(frame).collect()}
    pair, rest = counts[of("wet stone")], counts[of("wet")[0], 0]
    assert [pair[x] for x in T.SLOTS] == [0, 20, 4, 20] and (pair["f_t"], pair["f_o"]) == (1, 1)
    # Ordinary pairs are counted though no toxic text has them, and make the ordinary backoff.
    assert [rest[x] for x in T.SLOTS] == [0, 20, 0, 20] and (rest["f_t"], rest["f_o"]) == (0, 1)


def test_texts_are_counted_and_shuffled_once(ready):
    frame = ready.createDataFrame([("wet paper", 1, 0), ("wet stone wet paper", 0, 1)] * 4, "text string, toxic int, half int")
    counts = T._gathered(frame)
    found = sorted((r["v"], r["w"], *[r[x] for x in T.SLOTS], r["f_t"], r["f_o"], r["lefts"]) for r in counts.collect())
    wet, paper, stone = (int(T.tokens(w)[0]) for w in ("wet", "paper", "stone"))
    # Words with their left contexts, and pairs by their first word; the start and the end of a text are neither.
    words = [(0, wet, 4, 0, 0, 4, 0, 0, 2), (0, paper, 4, 0, 0, 4, 0, 0, 1), (0, stone, 0, 0, 0, 4, 0, 0, 1)]
    pairs = [(wet, paper, 4, 0, 0, 4, 1, 1, 0), (paper, T.END, 4, 0, 0, 4, 1, 1, 0)] + [(v, 0, 0, 0, 0, 4, 0, 1, 0) for v in (wet, stone)]
    assert found == sorted(words + pairs)
    ran = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert (ran.count("MapInArrow"), ran.count("ReusedExchange")) == (1, 1)


def test_words_score_by_definition(ready):
    r = random.Random(3)
    texts = [(" ".join(r.choices([f"w{n}" for n in range(60)], [1 / (n + 1) for n in range(60)], k=r.randint(1, 12))), int(i % 3 == 0), i % 2) for i in range(120)]
    found = {x["key"]: x["r"] for x in T.scoring_table(ready.createDataFrame(texts, "text string, toxic int, half int")).collect()}
    counts, lefts = {1: Counter(), 0: Counter()}, {}
    for text, toxic, _ in texts:
        words = text.split()
        counts[toxic].update(set(words))
        for left, word in zip([None, *words], words):
            lefts.setdefault(word, set()).add(left)
    contexts = sum(map(len, lefts.values()))
    chances = {}
    for c, n in counts.items():
        total, sizes = sum(n.values()), list(n.values())
        discount = T._discount(sizes.count(1), sizes.count(2))
        for word, before in lefts.items():
            # A word of few documents is one with all others like it.
            key = word if counts[0][word] + counts[1][word] >= T.LEAST_COUNT else None
            p = max(n[word] - discount, 0) / total + discount * len(n) / total * len(before) / contexts
            chances[c, key] = chances.get((c, key), 0) + p
    want = {T.RARE if k is None else int(T.tokens(k)[0]): math.log(p / chances[0, k]) for (c, k), p in chances.items() if c == 1}
    assert {k: x for k, x in found.items() if k >= 0} == pytest.approx(want)
    assert T.RARE in want and any(abs(x) < 1 for x in want.values())


def test_parts_have_every_row_once(ready, monkeypatch):
    monkeypatch.setattr(T, "LEAST_PART", 1)
    r = random.Random(8)
    table = {r.getrandbits(64) - (1 << 63): (r.random(), i) for i in range(500)} | {0: (0.5, -1)}
    frame = ready.createDataFrame([(k, x, n) for k, (x, n) in table.items()], "key bigint, x double, n bigint")
    wanted = np.array(sorted([*list(table)[::2], *[r.getrandbits(64) - (1 << 63) for _ in range(300)], 0]), np.int64)
    for rows, least in ((1000, 1), (60, 8)):
        parts = T.Parts(frame, ["x", "n"], rows)
        assert least <= len(parts.parts) and sum(len(p.value[0]) for _, _, p in parts.parts) == 501
        assert max(len(p.value[0]) for _, _, p in parts.parts) <= max(1.1 * rows, rows + 1)
        keys, x, n = parts.of(np.unique(wanted))
        assert [*zip(keys.tolist(), zip(x.tolist(), n.tolist()))] == [(k, table[k]) for k in np.unique(wanted).tolist() if k in table]
        parts.destroy()
    none = T.Parts(frame.limit(0), ["x", "n"], 10).of(wanted)
    assert [len(x) for x in none] == [0, 0, 0]


def test_a_large_table_and_many_labels_shuffle_no_text(insults, rows, monkeypatch):
    docs, labels, _ = insults
    # A key with several labels, and a row that comes twice.
    labels = labels.union(labels.where("doc_id % 50 = 0")).union(labels.where("doc_id % 70 = 0").selectExpr("doc_id", "1 - toxic"))
    docs = docs.union(docs.where("doc_id % 90 = 0"))
    want = rows(T.scored(docs, labels), "doc_id", "held_out", "score", "predicted")
    monkeypatch.setattr(T, "LEAST_PART", 100)
    monkeypatch.setattr(T, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(T, "CHUNK_BYTES", 20_000)
    learnt = []
    gathered = T._gathered
    monkeypatch.setattr(T, "_gathered", lambda *a: learnt.append(gathered(*a)) or learnt[-1])
    found = T.scored(docs, labels, model_rows=-1, label_rows=-1)
    # Neither tokens nor texts are rows of a shuffle: the last scoring has none, the counts are gathered without a join.
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (found, *learnt)]
    assert "Exchange" not in plans[0] and not any("Join" in x for x in plans)
    assert [r[:2] for r in rows(found, "doc_id", "held_out", "score", "predicted")] == [r[:2] for r in want]
    assert [r[2] for r in rows(found, "doc_id", "held_out", "score")] == pytest.approx([r[2] for r in want], abs=1e-9)


def test_labels_by_other_keys_than_integers(insults):
    docs, labels, _ = insults
    want = {str(r["doc_id"]): r["held_out"] for r in T.scored(docs, labels).collect()}
    named = [x.withColumn("doc_id", F.col("doc_id").cast("string")) for x in (docs, labels)]
    few, many = ({r["doc_id"]: (r["held_out"], r["score"]) for r in T.scored(*named, label_rows=n).collect()} for n in (T.LABEL_ROWS, -1))
    assert {k: v[0] for k, v in few.items()} == {k: v[0] for k, v in many.items()} == want
    assert max(abs(few[k][1] - many[k][1]) for k in few) < 1e-9
