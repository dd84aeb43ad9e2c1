"""A dataset from landing pages to SQL, its recovery, and streaming ingest."""

import json
import shutil
import warnings

import pytest
from pyspark.sql import functions as F

from runlake.functions import attachment_file
from runlake.plans import Dataset, DatasetFrames, register_views, sql
from runlake.plans.dataset import CommitConflict
from runlake.plans.views import view_prefixes
from runlake.sources import read_record_lines
from runlake.streaming import ingest_landing, ingest_pages, merge_landing, merge_stream


def rec(endpoint, n, **more):
    state = json.dumps({"interactiveState": json.dumps({"answer": str(n)})})
    return {"source_key": "s", "remote_endpoint": endpoint, "question_id": "q", "id": f"d{endpoint}", "score": n, "report_state": state, **more}


def land(folder, *pages):
    folder.mkdir(parents=True)
    for i, page in enumerate(pages):
        (folder / f"page{i:03d}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in page))
    return str(folder)


def fetch(ds, tmp_path, run, fetch_id, *records, record_type="answers", queried=None):
    path = land(tmp_path / f"land_{record_type}_{run}_{fetch_id}", records)
    ds.add_page(record_type, run, read_record_lines(ds.spark, path), fetch_id, "0", F.timestamp_seconds(F.lit(run)))
    ds.finish_fetch(record_type, run, fetch_id, queried)


@pytest.fixture
def ds(spark, tmp_path):
    return Dataset.create(spark, str(tmp_path / "ds"), "fall")


def test_end_to_end(spark, ds, tmp_path, rows):
    attachments = {"f.json": {"publicPath": "p/1", "contentType": "application/json"}}
    fetch(ds, tmp_path, 584, "1", rec("e1", 1), rec("e2", 2), rec("e1", 3), queried=5)
    assert ds.merge("answers", 584) == {"fetched": 3, "new": 2, "updated": 0, "removed": 0}
    assert ds.merge("answers", 584) is None  # nothing waits any more
    marked = rec("e3", 2.5, attachments=attachments, report_state=json.dumps({"interactiveState": json.dumps({"__attachment__": "f.json"})}))
    fetch(ds, tmp_path, 612, "1", rec("e2", 20), marked)
    assert ds.merge("answers", 612) == {"fetched": 2, "new": 1, "updated": 1, "removed": 0}
    fetch(ds, tmp_path, 584, "2", rec("e2", 7))
    assert ds.merge("answers", 584) == {"fetched": 1, "new": 0, "updated": 1, "removed": 1}

    reports = tmp_path / "ds/reports"
    reports.mkdir()
    (reports / "report_1.csv").write_text("student_id,res_1_q_answer\nPrompt,Why?\n7,a\n8,b\n")
    (reports / "report_2.csv").write_text("student_id,logins\n7,3\n")
    (reports / "report_3.csv").write_text("student_id,y\n7,3\n")
    (reports / "report_2_job_9.csv").write_text("student_id,z\n1,2\n")
    assert ds.add_report(1, "reports/report_1.csv", "student-answers")["row_count"] == 2
    ds.add_report(2, "reports/report_2.csv", "x", "usage")
    ds.add_report(3, "reports/report_3.csv", "coursework")
    ds.add_report(2, "reports/report_2_job_9.csv", "student-actions", job_id=9)

    assert rows(ds.pending_attachments(612), "name", "doc_id") == [("f.json", "de3")]
    name = spark.range(1).select(attachment_file(F.lit("s"), F.lit("p/1"), F.lit("f.json"))).head()[0]
    files = tmp_path / "ds/attachments"
    files.mkdir()
    (files / name).write_text('{"v":1}')
    (files / "stray.bin").write_bytes(b"\xff")
    assert ds.pending_attachments(612).count() == 0
    assert rows(ds.index_attachments(), "file") == [("stray.bin",)]
    failed = spark.createDataFrame([("d9", "z", 1, "gone")], "doc_id string, name string, k bigint, error string")
    ds.record_attachments(612, spark.range(3), failed)

    views = ds.register()
    assert set(views) == {
        "reports", "report_prompts", "answers", "history", "run_membership", "downloads", "attachment_files", "attachment_states",
        "attachment_content", "report_1", "report_2", "report_3", "report_2_job_9", "answers_584", "answers_612",
    }

    def q(text):
        return rows(sql(spark, text))

    assert q("select remote_endpoint, score, get_json_object(report_state, '$.interactiveState.answer') from answers") == [("e2", 7.0, "7"), ("e3", 2.5, None)]
    assert q("select remote_endpoint from answers_584") == [("e2",)] and q("select remote_endpoint from answers_612") == [("e2",), ("e3",)]
    assert q("select * from history") == []
    assert q("select * from reports") == sorted([(1, "7", "a", None), (1, "8", "b", None), (2, "7", None, 3)], key=repr)
    assert q("select run_id, res_1_q_answer from report_prompts") == [(1, "Why?")]
    assert q("select * from report_3") == [(3, 7, 3)] and q("select * from report_2_job_9") == [(2, 1, 2)]
    assert "content:binary" not in ds.frames().texts._jdf.queryExecution().toString()  # files are listed, and only texts opened
    assert q("select name, state from attachment_states") == [("f.json", '{"v":1}')]
    assert q("select name, public_path, content from attachment_content") == [("f.json", "p/1", '{"v":1}')]
    assert ("report", 3, "coursework", True) in q("select type, run_id, report_type, complete from downloads")
    got = {(r.type, r.run_id, r.job_id): r for r in ds.summary().collect()}
    assert got["answers", 612, None].coverage.asDict() == {"queried": None, "with_data": 2, "empty": None, "missing": None}
    fetched = got["attachments", 612, None]
    assert fetched.coverage.with_data == 3 and fetched.complete
    assert rows(spark.read.parquet(str(tmp_path / "ds/attachment_missing/run_id=612"))) == [("d9", "z", "gone")]
    assert rows(ds.totals()) == [("answers", 2), ("attachments", 1), ("report", 5)]

    # Files against manifest.
    (reports / "report_77.csv").write_text("event,ts\nx,1\n")
    drift = [tuple(r) for r in ds.drift().collect()]
    assert ("ORPHAN_FILE", "report_77.csv", "") in drift and ("UNKNOWN_TYPE", "run 3", "coursework") in drift
    assert not [d for d in drift if d[0] == "MISSING_FILE"]

    # A missing file costs its rows, not the union's columns.
    (reports / "report_2.csv").rename(tmp_path / "gone.csv")
    with pytest.warns(UserWarning, match="missing"):
        ds.register()
    assert sql(spark, "select * from reports").columns == ["run_id", "student_id", "res_1_q_answer", "logins"]
    assert len(q("select * from reports")) == 2


def test_sweep_merges_all_waiting(ds, tmp_path, rows):
    fetch(ds, tmp_path, 1, "1", rec("e1", 1), rec("e2", 1))
    fetch(ds, tmp_path, 2, "1", rec("e2", 2), rec("e3", 2))
    fetch(ds, tmp_path, 3, "1", rec("e9", 3), record_type="answers")
    assert ds.merge("answers", 1) == {"fetched": 2, "new": 1, "updated": 0, "removed": 0}
    summary = {r.run_id: r for r in ds.summary().collect()}
    assert summary[2].complete and summary[2].merge_counts.asDict() == {"fetched": 2, "new": 2, "updated": 0, "removed": 0}
    assert {r.version for r in ds.manifest().where("kind = 'store'").collect()} == {1}


def test_empty_refresh_and_history(ds, tmp_path, rows):
    h = dict(rec("e1", 1), history_id="h1")
    fetch(ds, tmp_path, 1, "1", h, dict(h, history_id="h2"), record_type="history")
    assert ds.merge("history", 1)["new"] == 2
    fetch(ds, tmp_path, 1, "2", record_type="history")
    assert ds.merge("history", 1) == {"fetched": 0, "new": 0, "updated": 0, "removed": 2}
    assert ds.frames().stores["history"].count() == 0
    fetch(ds, tmp_path, 2, "1", h, record_type="history")
    assert ds.merge("history", 2)["new"] == 1


def test_lost_membership_is_an_error(ds, tmp_path):
    fetch(ds, tmp_path, 1, "1", rec("e1", 1))
    ds.merge("answers", 1)
    shutil.move(tmp_path / "ds/membership", tmp_path / "lost")
    fetch(ds, tmp_path, 2, "1", rec("e2", 2))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        ds.merge("answers", 2)


def test_reindex(ds, tmp_path, rows):
    fetch(ds, tmp_path, 1, "1", rec("e1", 1))
    ds.merge("answers", 1)
    fetch(ds, tmp_path, 2, "1", rec("e2", 2))
    ds.merge("answers", 2)
    reports = tmp_path / "ds/reports"
    reports.mkdir()
    (reports / "report_5.csv").write_text("student_id,a\nPrompt,Why?\n7,x\n")
    (reports / "report_6.csv").write_text("student_id,logins\n7,3\n")
    ds.add_report(6, "reports/report_6.csv", "student-assignment-usage", filter_labels=["class: A"])
    # A store version without a membership of its own never committed.
    shutil.copytree(tmp_path / "ds/stores/answers/v=2", tmp_path / "ds/stores/answers/v=3")
    # Nor did one whose membership was cut off.
    for top in ("membership", "runs"):
        shutil.copytree(tmp_path / f"ds/{top}/v=2_answers", tmp_path / f"ds/{top}/v=4_answers")
    shutil.copytree(tmp_path / "ds/stores/answers/v=2", tmp_path / "ds/stores/answers/v=4")
    next((tmp_path / "ds/membership/v=4_answers").glob("id=*/_SUCCESS")).unlink()
    ds.reindex()
    m = {(r.kind, r.type, r.run_id): r for r in ds.manifest().collect()}
    assert m["store", "answers", None].version == 2 and m["store", "answers", None]["count"] == 2
    assert (m["download", "report", 5].report_type, m["download", "report", 5].recovered, m["download", "report", 5].row_count) == ("answers", False, 1)
    kept = m["download", "report", 6]
    assert (kept.report_type, kept.recovered, kept.filter_labels, kept.slug) == ("usage", False, ["class: A"], "student-assignment-usage")
    assert m["download", "answers", 1].merge_counts.new == 1 and not m["download", "answers", 1].recovered
    # And from nothing but the files.
    shutil.move(tmp_path / "ds/manifest", tmp_path / "old_manifest")
    ds.reindex()
    m = {(r.kind, r.type, r.run_id): r for r in ds.manifest().collect()}
    assert (m["download", "report", 6].report_type, m["download", "report", 6].recovered) == ("recovered", True)
    assert m["download", "answers", 2].recovered and m["store", "answers", None]["count"] == 2
    fetch(ds, tmp_path, 3, "1", rec("e3", 3))
    assert ds.merge("answers", 3) == {"fetched": 1, "new": 1, "updated": 0, "removed": 0}


def test_streamed_pages_resume_and_replay(spark, ds, tmp_path, rows):
    landing = tmp_path / "landing"
    land(landing, [rec("e1", 1), rec("e2", 2)], [rec("e2", 3)])
    ingest_pages(ds, "answers", 7, str(landing), str(tmp_path / "ck"), pages_per_batch=1)
    # More pages land; the checkpoint is the cursor.
    (landing / "page002.jsonl").write_text(json.dumps(rec("e4", 4)) + "\n")
    counts = merge_stream(ds, "answers", 7, str(landing), str(tmp_path / "ck"), pages_per_batch=1)
    assert counts == {"fetched": 4, "new": 3, "updated": 0, "removed": 0}
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == [("e1", 1), ("e2", 3), ("e4", 4)]
    assert merge_stream(ds, "answers", 7, str(landing), str(tmp_path / "ck")) is None
    # A page that lands after the merge opens the fetch again and wins.
    (landing / "page003.jsonl").write_text(json.dumps(rec("e1", 9)) + "\n" + json.dumps(rec("e5", 5)) + "\n")
    counts = merge_stream(ds, "answers", 7, str(landing), str(tmp_path / "ck"))
    assert counts == {"fetched": 6, "new": 1, "updated": 3, "removed": 0}
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == [("e1", 9), ("e2", 3), ("e4", 4), ("e5", 5)]
    assert merge_stream(ds, "answers", 7, str(landing), str(tmp_path / "ck")) is None


def test_pages_are_ordered_by_number(ds, tmp_path, rows):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in (10, 9, 2):
        (landing / f"page-{n}.jsonl").write_text(json.dumps(rec("e1", n)) + "\n")
    merge_stream(ds, "answers", 7, str(landing), str(tmp_path / "ck"))
    assert rows(ds.frames().stores["answers"], "score") == [(10,)]


def test_two_writers_from_one_commit(spark, ds, tmp_path, rows, monkeypatch):
    """The second finds the commit taken, clears away what it wrote and merges on top of the first."""
    fetch(ds, tmp_path, 1, "1", rec("e1", 1))
    fetch(ds, tmp_path, 2, "1", rec("e2", 2))
    other, commit = Dataset(spark, ds.root), Dataset._commit
    raced = []

    def slow(self, entries, number):
        if self is ds and not raced:
            raced.append(number)
            assert other.merge("answers", 2, sweep=False)["new"] == 1
        commit(self, entries, number)

    monkeypatch.setattr(Dataset, "_commit", slow)
    assert ds.merge("answers", 1, sweep=False) == {"fetched": 1, "new": 1, "updated": 0, "removed": 0}
    assert raced and rows(other.frames().stores["answers"], "remote_endpoint") == [("e1",), ("e2",)]
    assert len(list((tmp_path / "ds/stores/answers").glob("v=*/id=*"))) == 2 and not list((tmp_path / "ds/staging").glob("*/id=*"))
    assert not [d for d in ds.drift().collect() if d.code == "MISSING_FILE"]
    with pytest.raises(CommitConflict):
        ds._commit([], raced[0])


def test_vacuum_and_drift(ds, tmp_path, rows):
    for run, n in ((1, 1), (2, 2), (1, 3)):
        fetch(ds, tmp_path, run, str(n), rec(f"e{n}", n))
        ds.merge("answers", run)
    orphans = [r.subject for r in ds.drift().collect() if r.code == "ORPHAN_FILE"]
    # The second version still holds the bucket of e2, which the third did not touch.
    assert len([o for o in orphans if o.startswith("stores/answers/v=")]) == 1 and len([o for o in orphans if o.startswith("membership/v=1_")]) == 1
    before = rows(ds.frames().stores["answers"], "remote_endpoint", "score")
    gone = ds.vacuum()
    assert {g.split("/")[0] for g in gone} >= {"stores", "membership", "manifest"}
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == before
    assert ds.drift().count() == 0 and ds.vacuum() == []
    ds.reindex()
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == before
    fetch(ds, tmp_path, 4, "1", rec("e4", 4))
    assert ds.merge("answers", 4)["new"] == 1


def test_reindex_keeps_empty_refreshes_and_waiting_fetches(ds, tmp_path, rows):
    fetch(ds, tmp_path, 1, "1", rec("e1", 1), rec("e2", 1))
    ds.merge("answers", 1)
    fetch(ds, tmp_path, 2, "1", rec("e2", 2))
    ds.merge("answers", 2)
    fetch(ds, tmp_path, 1, "2")
    assert ds.merge("answers", 1)["removed"] == 1
    fetch(ds, tmp_path, 3, "1", rec("e3", 3))  # landed, not merged
    shutil.move(tmp_path / "ds/manifest", tmp_path / "old_manifest")
    ds.reindex()
    assert rows(ds.frames().membership, "run_id", "remote_endpoint") == [(2, "e2")]
    fetch(ds, tmp_path, 4, "1", rec("e4", 4))
    assert ds.merge("answers", 4)["new"] == 1
    assert rows(ds.frames().stores["answers"], "remote_endpoint") == [("e2",), ("e3",), ("e4",)]


def test_attachment_index_without_a_folder_and_after_reindex(ds, tmp_path, rows):
    attachments = {"f.json": {"publicPath": "p/1", "contentType": "application/json"}}
    fetch(ds, tmp_path, 1, "1", rec("e2", 1, attachments=attachments), rec("e1", 1, attachments={"g.json": attachments["f.json"]}))
    ds.merge("answers", 1)
    assert ds.index_attachments().count() == 0
    files = tmp_path / "ds/attachments"
    files.mkdir()
    for name in ("f.json", "g.json"):
        file = ds.spark.range(1).select(attachment_file(F.lit("s"), F.lit("p/1"), F.lit(name))).head()[0]
        (files / file).write_text("{}")
    ds.reindex()
    assert rows(ds.frames().attachments, "name") == [("g.json",)]  # the first record in identity order names the file


def test_view_prefixes():
    assert view_prefixes([(None, "main")]) == [""]
    assert view_prefixes([("a", "main"), (None, "fall")]) == ["a__", "fall__"]
    with pytest.raises(ValueError, match="share a view prefix"):
        view_prefixes([("School", "x"), (None, "school")])


def test_fresh_dataset_has_typed_empty_views(spark, rows):
    register_views(spark, [(None, DatasetFrames("fresh"))])
    assert sql(spark, "select count(*) from answers").head()[0] == 0
    assert sql(spark, "select * from reports").dtypes == [("run_id", "bigint")]
    assert sql(spark, "select filename, id12, name, content, state from attachment_states").count() == 0


def files_below(folder):
    return {str(f.relative_to(folder)): f.read_bytes() for f in folder.rglob("*.parquet")}


def test_a_small_fetch_leaves_other_buckets_alone(ds, tmp_path, rows, monkeypatch):
    """Copy-on-write: untouched buckets stay byte for byte, and a merge reads only touched ones."""
    fetch(ds, tmp_path, 1, "1", *[rec(f"e{n}", n) for n in range(300)])
    ds.merge("answers", 1)
    before, store = files_below(tmp_path / "ds/stores"), ds._entries()[1]
    buckets = {b["bucket"] for e in store if e["kind"] == "store" for b in e["buckets"]}
    assert len(buckets) == 32
    read, read_files = [], Dataset._bucket_files

    def spy(self, live, wanted, form):
        read.append((form, len(wanted)))
        frame = read_files(self, live, wanted, form)
        assert {int(f.split("_bucket=")[1].split("/")[0]) for f in frame.inputFiles()} == set(wanted)
        return frame

    monkeypatch.setattr(Dataset, "_bucket_files", spy)
    fetch(ds, tmp_path, 2, "1", rec("e7", 70), rec("new", 1))
    assert ds.merge("answers", 2) == {"fetched": 2, "new": 1, "updated": 1, "removed": 0}
    assert read and all(form == "records" and n <= 2 for form, n in read)
    after = files_below(tmp_path / "ds/stores")
    assert all(after[f] == data for f, data in before.items())
    fresh = {f.split("_bucket=")[1].split("/")[0] for f in set(after) - set(before) if "/records/" in f}
    assert len(fresh) <= 2
    entry = next(e for e in ds._entries()[1] if e["kind"] == "store")
    assert entry["count"] == 301 and {b["bucket"] for b in entry["buckets"]} == buckets | {int(f) for f in fresh}
    assert len({b["path"] for b in entry["buckets"]}) == 2
    want = sorted([(f"e{n}", 70 if n == 7 else n) for n in range(300)] + [("new", 1)], key=repr)
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == want
    # The other version's unused buckets go, the used ones stay.
    gone = ds.vacuum()
    assert [g for g in gone if "/records/_bucket=" in g] and rows(ds.frames().stores["answers"], "remote_endpoint", "score") == want
    ds.reindex()
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == want


def test_old_buckets_fit_a_new_column_map(ds, tmp_path, rows):
    """Kinds of all buckets make the column map; buckets typed under an older one are widened or typed anew when read."""
    fetch(ds, tmp_path, 1, "1", *[rec(f"e{n}", n, late=None, mixed=n, text="x") for n in range(40)])
    ds.merge("answers", 1)
    types = dict(ds.frames().stores["answers"].dtypes)
    assert (types["score"], types["late"], types["mixed"]) == ("bigint", "string", "bigint")
    fetch(ds, tmp_path, 2, "1", rec("w", 2.5, late=7, mixed="word", more=[1]))
    ds.merge("answers", 2)
    store = ds.frames().stores["answers"]
    types = dict(store.dtypes)
    assert (types["score"], types["late"], types["more"]) == ("double", "bigint", "string")
    got = {r["remote_endpoint"]: r for r in store.collect()}
    assert got["e3"].score == 3.0 and got["e3"].late is None and got["e3"].mixed == "3" and got["e3"].more is None
    assert (got["w"].late, got["w"].mixed, got["w"].more, got["w"].text) == (7, '"word"', "[1]", None)
    # Without the odd record the map is as narrow as before.
    fetch(ds, tmp_path, 2, "2")
    assert ds.merge("answers", 2)["removed"] == 1
    types = dict(ds.frames().stores["answers"].dtypes)
    assert (types["score"], types["mixed"]) == ("bigint", "bigint") and "more" not in types
    assert len([e for e in ds._entries()[1] if e["kind"] == "store"][0]["layouts"]) == 1


def test_late_pages_of_a_replaced_fetch_are_left(ds, tmp_path, rows):
    fetch(ds, tmp_path, 1, "1", rec("q1", 1), rec("q2", 2))
    ds.merge("answers", 1)
    fetch(ds, tmp_path, 1, "2", rec("q1", 10))
    ds.merge("answers", 1)
    late = land(tmp_path / "late", [rec("q1", 99), rec("q3", 3)])
    ds.add_page("answers", 1, read_record_lines(ds.spark, late), "1", "1", F.timestamp_seconds(F.lit(1)))
    with pytest.warns(UserWarning, match="which a newer one replaced"):
        ds.finish_fetch("answers", 1, "1")
    assert ds.merge("answers", 1) is None
    fetch(ds, tmp_path, 1, "3", rec("q1", 11), rec("q4", 4))  # waiting, with the late page on disk
    assert ds.merge("answers", 1) == {"fetched": 2, "new": 1, "updated": 1, "removed": 0}
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score") == [("q1", 11), ("q4", 4)]
    assert {g for g in ds.vacuum() if g.startswith("segments")} == {"segments/answers/fetch=1/run_id=1", "segments/answers/fetch=2/run_id=1"}


def test_a_crash_between_checkpoint_and_finish(ds, tmp_path, rows, monkeypatch):
    """The stream has taken the page, the manifest does not know; the next call finds the batch."""
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "ck")
    land(landing, [rec("e1", 1)])
    merge_stream(ds, "answers", 7, str(landing), checkpoint)
    (landing / "page001.jsonl").write_text(json.dumps(rec("e2", 2)) + "\n")
    with monkeypatch.context() as m:
        m.setattr(Dataset, "finish_fetches", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError, match="died"):
            merge_stream(ds, "answers", 7, str(landing), checkpoint)
    assert merge_stream(ds, "answers", 7, str(landing), checkpoint) == {"fetched": 2, "new": 1, "updated": 1, "removed": 0}
    assert rows(ds.frames().stores["answers"], "remote_endpoint") == [("e1",), ("e2",)]
    assert next(e["batches"] for e in ds._entries()[1] if e["kind"] == "segment") == ["000000000", "000000001"]


def test_one_stream_for_many_runs(ds, tmp_path, rows):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "ck")
    assert merge_landing(ds, "answers", str(landing), checkpoint) == {}
    land(landing / "run_id=5/fetch=1", [rec("e1", 1)], [rec("e2", 2)])
    land(landing / "run_id=12/fetch=9", [rec("e2", 12)])
    counts = merge_landing(ds, "answers", str(landing), checkpoint, fetched_at=F.timestamp_seconds("run_id"))
    assert counts == {5: {"fetched": 2, "new": 1, "updated": 0, "removed": 0}, 12: {"fetched": 1, "new": 1, "updated": 0, "removed": 0}}
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score", "_run_id") == [("e1", 1, 5), ("e2", 12, 12)]
    assert merge_landing(ds, "answers", str(landing), checkpoint) == {}
    # A late page of a current fetch, a newer fetch without records, a late page of the one that this replaces.
    (landing / "run_id=5/fetch=1/page7.jsonl").write_text(json.dumps(rec("e3", 3)) + "\n")
    land(landing / "run_id=12/fetch=10", [])
    (landing / "run_id=12/fetch=9/page1.jsonl").write_text(json.dumps(rec("e9", 9)) + "\n")
    with pytest.warns(UserWarning, match="fetch 9, which a newer one replaced"):
        ingest_landing(ds, "answers", str(landing), checkpoint)
        ingest_landing(ds, "answers", str(landing), checkpoint)
    counts = merge_landing(ds, "answers", str(landing), checkpoint)
    assert counts[5] == {"fetched": 3, "new": 1, "updated": 2, "removed": 0} and counts[12]["fetched"] == 0
    assert rows(ds.frames().stores["answers"], "remote_endpoint", "score", "_run_id") == [("e1", 1, 5), ("e2", 2, 5), ("e3", 3, 5)]


def test_a_changed_report_is_loud(spark, ds, tmp_path, rows):
    """Cells that do not fit the recorded types are NULL, with a warning and a row of drift."""
    reports = tmp_path / "ds/reports"
    reports.mkdir()
    (reports / "report_2.csv").write_text("student_id,logins\n7,3\n8,\n")
    ds.add_report(2, "reports/report_2.csv", "x", "usage")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        ds.register()
    assert ds.drift().count() == 0
    (reports / "report_2.csv").write_text("student_id,logins\n7,many\n8,4\n9,few\n")
    with pytest.warns(UserWarning, match="2 cells of logins are no BIGINT"):
        ds.register()
    assert rows(sql(spark, "select student_id, logins from reports")) == [(7, None), (8, 4), (9, None)]
    assert rows(ds.drift()) == [("FAILED_CAST", "run 2", "logins: 2 cells are no BIGINT")]


def test_views_are_dropped_by_session(spark):
    """What another session registers under a prefix leaves this session's views alone."""
    frames = DatasetFrames("x", member_runs=[("answers", 5)])
    register_views(spark, [(None, frames)])
    other = spark.newSession()
    register_views(other, [(None, DatasetFrames("x"))])
    assert spark.catalog.tableExists("answers_5") and not other.catalog.tableExists("answers_5")
    register_views(spark, [(None, DatasetFrames("x"))])
    assert not spark.catalog.tableExists("answers_5")
