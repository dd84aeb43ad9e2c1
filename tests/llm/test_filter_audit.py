import itertools
import random

import duckdb
import pandas as pd
import pytest

from runlake.llm import filter_audit
from runlake.llm.queries import ORACLES

LABELS = "doc_id bigint, quality int, toxic int, source string, text string"


def failures(docs):
    """Letters of the filters that each ``(id, text, source)`` fails, by definition."""
    out = []
    for i, text, _ in docs:
        text = text or ""
        w = text.encode().split()
        low = [j for j, t, _ in docs if (t or "") == text and j is not None]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": bool(low) and (i is None or min(low) < i),
        }
        out.append({f for f in fails if fails[f]})
    return out


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails, rows = failures(docs), []
    for part in {s or "" for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [i for i, x in own if f in x and not x & before]
                shapley[f] += len(gone)
                lines.append((
                    part, "".join(order), k + 1, sum(not x & (before | {f}) for _, x in own), len(gone), sum(f in x and bool(x & before) for _, x in own),
                    sum(x == {f} for _, x in own), sum(i in good for i in gone), sum(i in toxic for i in gone), f,
                ))
        rows += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(rows)


def write_files(spark, folder, docs, files):
    """The documents dealt to so many files, later ones first, so that smaller ids arrive late."""
    for k in range(files):
        frame = spark.createDataFrame(docs[k::files], "doc_id bigint, text string, source string, `a.b` string, part string, n int, id string")
        frame.coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture(scope="module")
def audit_docs(prose):
    r = random.Random(2)
    bodies = [prose(k, r.choice([5, 150, 260])) + r.choice(["", " #", " A", " ABC DEF" * 9]) for k in range(14)] + ["x y " * 150, "", None]
    docs = [(r.choice([None, *range(-3, 60)]), r.choice(bodies), r.choice([None, "", "s", "s", "s", "t"])) for _ in range(160)]
    docs += [docs[0], docs[0], (2, "Word " * 40, "t"), (2, "other", "t")]
    r.shuffle(docs)
    return docs


@pytest.fixture(scope="module")
def audit_labels():
    r = random.Random(3)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)]
    return [*labels, (4, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("files,batches", [(1, 1), (5, 5), (6, 2)])
def test_audit_equals_brute_force(ready, rows, audit_docs, audit_labels, tmp_path, files, batches):
    write_files(ready, tmp_path / "documents.parquet", [(*d, "x", "p", 1, "z") for d in audit_docs], files)
    labels = ready.createDataFrame([(*x, "l", "t") for x in audit_labels], LABELS)
    found = filter_audit.audited(ready, str(tmp_path / "documents.parquet"), labels, batches=batches)
    want = brute_audit(audit_docs, audit_labels)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 600 * 3


def test_audit_equals_its_sql(ready, audit_docs, tmp_path):
    docs = [d for d in audit_docs if d[0] is not None]
    write_files(ready, tmp_path / "documents.parquet", [(*d, "x", "p", 1, "z") for d in docs], 3)
    found = filter_audit.audited(ready, str(tmp_path / "documents.parquet"), ready.createDataFrame([(8, 1, 0, "", "")], LABELS))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.execute("CREATE TABLE labels AS SELECT 8 AS doc_id, 1 AS quality, 0 AS toxic")
    sql = con.sql(ORACLES["op11_filter_audit"])
    assert sorted(map(tuple, found.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_files_that_come_later(ready, audit_docs, audit_labels, tmp_path, monkeypatch):
    """A second call with the same folder takes in new files only, and takes back what they outdate.

    Texts stay with their state keys, though there would be more keys for more texts.
    """
    monkeypatch.setattr(filter_audit, "TEXTS_PER_KEY", 20)
    labels = ready.createDataFrame([(*x, "l", "t") for x in audit_labels], LABELS)
    path, work = str(tmp_path / "documents.parquet"), str(tmp_path / "work")
    late = sorted(audit_docs, key=lambda d: (d[0] is None, d[0] or 0), reverse=True)
    for docs in (late[:100], late[100:]):
        write_files(ready, path, [(*d, "x", "p", 1, "z") for d in docs], 2)
        counts = filter_audit.counters(ready, path, labels, folder=work)
    assert sorted(map(tuple, filter_audit.interactions(counts).collect())) == brute_audit(audit_docs, audit_labels)
    before = sorted(map(tuple, counts.collect()))
    assert sorted(map(tuple, filter_audit.counters(ready, path, labels, folder=work).collect())) == before


def test_a_smaller_id_takes_back_the_earlier_mask():
    row = lambda i, part, bits: pd.DataFrame([(b"t", False, i, part, bits, 1)], columns=filter_audit.HELD)
    held, changes = filter_audit.retracted(row(1, "", 0).iloc[:0], row(9, "p", 3))
    assert changes.values.tolist() == [["p", 3, 1]]
    held, changes = filter_audit.retracted(held, row(5, "q", 3))
    assert sorted(changes.values.tolist()) == [["p", 3, -1], ["p", 19, 1], ["q", 3, 1]] and held["id"].tolist() == [5]
    held, changes = filter_audit.retracted(held, row(7, "p", 3))
    assert changes.values.tolist() == [["p", 19, 1]] and held["id"].tolist() == [5]
    held, changes = filter_audit.retracted(held, row(5, "q", 3))  # the same document again is no copy
    assert changes.values.tolist() == [["q", 3, 1]] and held["n"].tolist() == [2]


def test_no_documents_and_hot_text(ready, tmp_path):
    labels = ready.createDataFrame([], LABELS)
    empty, hot = str(tmp_path / "empty.parquet"), str(tmp_path / "hot.parquet")
    ready.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(empty)
    assert filter_audit.audited(ready, empty, labels).count() == 0
    docs = [(i, "same" if i % 3 else f"own {i}", "s", "x", "p", 1, "z") for i in range(600)]
    write_files(ready, hot, docs, 4)
    counts = {(r["part"], r["bits"]): r["n"] for r in filter_audit.counters(ready, hot, labels).collect()}
    assert counts == {("s", 1): 201, ("s", 17): 399}
