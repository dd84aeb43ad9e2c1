import os

import corpus_pipeline
import duckdb
import pytest
from test_mixing_packing import check_packed

from runlake.llm import near_dedup
from runlake.llm.common import written
from runlake.llm.queries import MIX_CTES
from test_near_dedup import brute


@pytest.fixture(scope="module")
def corpus(ready, prose, tmp_path_factory):
    """Prose of several sources with copies, near copies and junk."""
    rows = [(i, prose(i % 90, 120), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(120)]
    rows += [(200 + i, prose(i, 120).replace("ther", "THER", 1) + " tail", "en", "s1", 0) for i in range(30)]
    rows += [(300 + i, " ".join(w + "***" for w in prose(i, 100).split()), "en", "s2", 0) for i in range(25)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    ready.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(os.path.join(folder, "documents.parquet"))
    return folder


def test_every_stage(ready, corpus):
    docs = ready.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(ready, docs, corpus), f"test-{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "near_dedup":
            want = [(i, keep) for i, _, _, keep in brute([(r["doc_id"], r["text"]) for r in before.collect()], 5)]
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(i for i, keep in want if keep)
        if name == "source_mix":
            con = duckdb.connect()
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in before.collect()])
            times = con.execute(f"WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES} SELECT doc_id, times FROM mix").fetchall()
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(i for i, n in times for _ in range(n))
    clean = {i for i in range(120)} | {200 + i for i in range(30)}
    assert {r["doc_id"] for r in kept["quality_rules"]} == clean
    assert not {r["doc_id"] for r in kept["quality_classifier"]} & set(range(300, 325))
    check_packed(kept["packing"], [(r["doc_id"], r["text"]) for r in kept["source_mix"]])
    as_run = corpus_pipeline.run(ready, corpus).collect()
    pieces = lambda found: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in found)
    assert pieces(as_run) == pieces(kept["packing"])


def test_no_documents(ready, corpus, tmp_path):
    ready.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(ready, str(tmp_path)).count() == 0


def test_defaults():
    assert near_dedup.WIDTH == 5 and near_dedup.PERCENT == 80
