import json

import pytest
from pyspark.sql import functions as F

from runlake.functions import file_id12
from runlake.operators import (
    answers_long, attach_learner, attachment_content, attachment_index, attachment_index_refs, attachment_refs, attachment_states,
    carry_provenance, dataset_listing, dataset_totals, dedup_refs, drift_report, membership_of, newest_committed, pair_results,
    quarantine, recover_report_type, report_prompts, report_rows, reports_to_answers, scan_run_attachments, select_refs,
    unreferenced_files, union_runs,
)


def report(spark):
    return spark.createDataFrame(
        [("Prompt", "Why?"), ("Correct answer", None), ("7", "a"), ("8", "b"), (None, "c")], "student_id string, res_1_q1_answer string"
    )


def test_pseudo_headers(spark, rows):
    r = report(spark)
    assert rows(report_rows(r, "answers")) == [("7", "a"), ("8", "b")]
    assert report_rows(r, "usage").count() == 5
    assert rows(report_prompts(r, "answers")) == [("Correct answer", None), ("Prompt", "Why?")]
    assert report_prompts(r, "usage").count() == 0


def test_union_runs(spark, rows):
    usage = spark.createDataFrame([(7, 3)], "student_id bigint, logins bigint")
    runs = {1: (report(spark), "answers"), 2: (usage, "usage"), 3: (usage, "coursework")}
    assert rows(union_runs(runs)) == sorted([(1, "7", "a", None), (1, "8", "b", None), (2, "7", None, 3)], key=repr)
    assert union_runs(runs, prompts=True).count() == 2
    assert union_runs({3: (usage, "coursework")}) is None


def test_answers_report_without_students_costs_only_its_rows(spark):
    log = spark.createDataFrame([("x",)], "event string")
    with pytest.warns(UserWarning, match="student_id"):
        united = union_runs({1: (log, "answers"), 2: (log, "log")})
    assert [tuple(r) for r in united.collect()] == [(2, "x")]


def test_quarantine_and_recovery(spark, rows):
    d = spark.createDataFrame([(1, "answers"), (2, "brand-new"), (3, None), (4, "recovered")], "run_id int, report_type string")
    known, rest = quarantine(d)
    assert rows(known, "run_id") == [(1,), (4,)] and rows(rest, "run_id") == [(2,), (3,)]
    assert tuple(recover_report_type(report(spark)).head()) == ("answers", False)
    assert tuple(recover_report_type(report(spark).where("student_id = '7'")).head()) == ("recovered", True)
    assert tuple(recover_report_type(report(spark).where("false")).head()) == ("recovered", True)
    assert tuple(recover_report_type(spark.createDataFrame([("a", "1")], "event string, ts string")).head()) == ("log", False)


def test_positional_columns(spark, rows):
    r = spark.createDataFrame(
        [(1, "s1", 10, "e1", "one", "A", "B", "u", "e9", "C")],
        "run_id int, student_id string, user_id int, res_1_remote_endpoint string, res_1_name string, res_1_open_response_5_answer string,"
        " res_1_mc_6_answer string, res_1_mc_6_url string, res_12_remote_endpoint string, res_12_mc_6_answer string",
    )
    long = answers_long(r, fields=("answer", "url"))
    assert rows(long, "n", "remote_endpoint", "question_id", "answer", "url") == sorted([
        (1, "e1", "open_response_5", "A", None), (1, "e1", "mc_6", "B", "u"), (12, "e9", "mc_6", "C", None)], key=repr)
    answers = spark.createDataFrame([("s", "e1", "mc_6", 5), ("s", "e2", "mc_6", 6)], "source_key string, remote_endpoint string, question_id string, score int")
    assert rows(reports_to_answers(long, answers), "question_id", "answer", "score") == [("mc_6", "B", 5)]
    assert rows(attach_learner(answers, r), "remote_endpoint", "user_id") == [("e1", 10), ("e2", None)]
    with pytest.raises(ValueError):
        answers_long(r.select("run_id", "student_id"))


RECORDS = "source_key string, remote_endpoint string, question_id string, id string, attachments string, report_state string"


def records(spark):
    state = json.dumps({"a": [{"__attachment__": "f.json"}]})
    return spark.createDataFrame([
        ("src", "e1", "q1", "d1", json.dumps({"f.json": {"publicPath": "p/1", "contentType": "application/json", "folder": {"x": 1}}, "b.mp3": {"publicPath": "p/2", "contentType": "audio/mp3"}}), state),
        ("src", "e2", "q1", "d2", json.dumps({"g.json": {"publicPath": "p/1", "contentType": "application/json"}}), None),
        ("src", "e3", "q2", None, json.dumps({"z": {"publicPath": "p/3"}}), "broken"), ("src", "e4", "q2", "d4", "nope", state), ("src", "e5", "q2", "d5", None, state),
    ], RECORDS)


def test_refs(spark, rows):
    refs = attachment_refs(records(spark), "answers")
    assert rows(refs, "doc_id", "name", "public_path", "content_type", "state") == sorted([
        ("d1", "f.json", "p/1", "application/json", True), ("d1", "b.mp3", "p/2", "audio/mp3", False),
        ("d2", "g.json", "p/1", "application/json", False), ("", "z", "p/3", "", False)], key=repr)
    history = records(spark).withColumn("history_id", F.concat(F.lit("h"), "id"))
    assert rows(attachment_refs(history, "history").where("name = 'z'"), "doc_id", "collection", "history_id") == [("", "history", None)]
    assert rows(select_refs(refs, answer="d1", name="f.json"), "name") == [("f.json",)]
    assert select_refs(refs, history="d1").count() == 0
    assert select_refs(refs, question="q2").count() == 1


def test_scan_one_run(spark, rows):
    r = records(spark)
    members = membership_of(r.where("remote_endpoint = 'e2'").withColumn("_run_id", F.lit(5)), "answers")
    assert rows(scan_run_attachments({"answers": r}, members, 5), "name") == [("g.json",)]
    with pytest.raises(LookupError):
        scan_run_attachments({}, members, 5)


def test_index(spark, rows):
    refs = attachment_refs(records(spark), "answers", F.substring("remote_endpoint", 2, 9).cast("bigint"))
    assert rows(dedup_refs(refs), "public_path", "name") == [("p/1", "f.json"), ("p/2", "b.mp3"), ("p/3", "z")]
    ids = {p: refs.sparkSession.createDataFrame([("src", p)], "s string, p string").select(file_id12("s", "p")).head()[0] for p in ("p/1", "p/2", "p/3")}
    files = spark.createDataFrame([(f"{ids['p/1']}_f.json", 10, '{"v":1}'), (f"{ids['p/2']}_b.mp3", 20, "x"), ("stray", 1, "")], "file string, size bigint, content string")
    index = attachment_index(refs, files)
    assert rows(index, "name", "size", "state", "n_refs") == [("b.mp3", 20, False, 1), ("f.json", 10, True, 2)]
    assert rows(attachment_index_refs(refs), "id12", "remote_endpoint") == sorted([(ids["p/1"], "e1"), (ids["p/1"], "e2"), (ids["p/2"], "e1"), (ids["p/3"], "e3")])
    # g.json names the shared file too, under a name that is not on disk.
    assert rows(unreferenced_files(refs, files), "file") == [("stray",)]
    assert rows(attachment_states(index, files), "name", "state") == [("f.json", '{"v":1}')]
    assert rows(attachment_content(index, files), "name", "content") == [("f.json", '{"v":1}')]
    broken = files.withColumn("content", F.lit("{"))
    assert rows(attachment_content(index, broken), "content", "state") == [("{", None)]


@pytest.mark.parametrize("block", [2, 1000])
def test_pair_results(spark, rows, block):
    refs = spark.createDataFrame([("d", "n", i, f"p{i}") for i in range(5)] + [("d", "m", 9, "pm")], "doc_id string, name string, position bigint, public_path string")
    results = spark.createDataFrame(
        [("d", "n", 1, "u0", ""), ("d", "n", 3, "u1", None), ("d", "n", 7, None, "gone"), ("d", "n", 8, "u3", ""), ("x", "n", 9, "ux", "")],
        "doc_id string, name string, position bigint, url string, error string",
    )
    paired, failed = pair_results(refs, results, block)
    assert rows(paired, "public_path", "url") == [("p0", "u0"), ("p1", "u1"), ("p3", "u3")]
    assert rows(failed) == [("d", "n", 3, "gone")]


PRIOR = "type string, run_id int, job_id int, slug string, report_type string, recovered boolean, filter_labels array<string>, coverage struct<n:int>"


def test_carry_provenance(spark, rows):
    rebuilt = spark.createDataFrame(
        [("report", 1, None, "", "recovered", True, None, None), ("report", 2, None, "", "log", False, None, None), ("report_job", 1, 4, "", "recovered", True, None, None)], PRIOR
    )
    prior = spark.createDataFrame(
        [("report", 1, None, "student-answers", "answers", False, ["a"], (3,)), ("report", 2, None, "s2", "usage", True, [], None), ("report_job", 1, 5, "s3", "answers", False, None, None)], PRIOR
    )
    assert rows(carry_provenance(rebuilt, prior), "type", "run_id", "slug", "report_type", "recovered", "filter_labels", "coverage.n") == sorted([
        ("report", 1, "student-answers", "answers", False, ["a"], 3), ("report", 2, "s2", "log", False, None, None),
        ("report_job", 1, "", "recovered", True, None, None)], key=repr)


def test_newest_committed(spark, rows):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "type string, version bigint")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 7)], "type string, version bigint")
    assert rows(newest_committed(v, m, ["type"])) == [("a", 1), ("b", 1), ("c", 0)]


def test_totals_and_listing(spark, rows):
    stores = spark.createDataFrame([("d1", "answers", 3)], "ref string, type string, count bigint")
    downloads = spark.createDataFrame([("d1", "report", 5), ("d1", "report_job", None), ("d1", "answers", 9)], "ref string, type string, row_count bigint")
    files = spark.createDataFrame([("d1",), ("d1",)], "ref string")
    totals = dataset_totals(stores, downloads, files, ["ref"])
    assert rows(totals, "kind", "total") == [("answers", 3), ("attachments", 2), ("report", 5)]
    m = spark.sql("select 'd2' ref, 'B' name, timestamp'2024-01-01' created_at union all select 'd1', 'A', timestamp'2024-01-02'")
    listed = dataset_listing(m, totals, spark.createDataFrame([("d1", 10), ("d1", 5)], "ref string, size bigint"), F.lit("2024-01-03").cast("timestamp"))
    assert [tuple(r) for r in listed.collect()] == [("d1", "A", 86400, 3, 0, 5, 2, 15), ("d2", "B", 172800, 0, 0, 0, 0, 0)]


def test_drift(spark):
    expected = spark.createDataFrame([("store answers", "answers.v2.jsonl", False), ("", "report_1.csv", True)], "subject string, file string, download boolean")
    downloads = spark.createDataFrame([("report", 1, "weird", True, False), ("answers", 2, None, False, True), ("report", 3, "recovered", True, True)], "type string, run_id int, report_type string, complete boolean, recovered boolean")
    files = spark.createDataFrame([("report_1.csv",), ("answers.v1.jsonl",), ("notes.txt",), ("report_9_job_2.csv",)], "file string")
    assert [tuple(r) for r in drift_report(expected, downloads, files, owned=r"^(answers\.v\d+\.jsonl|report_.*\.csv)$").collect()] == [
        ("INCOMPLETE", "run 2", "answers"), ("MISSING_FILE", "store answers", "answers.v2.jsonl"), ("ORPHAN_FILE", "answers.v1.jsonl", ""),
        ("ORPHAN_FILE", "report_9_job_2.csv", ""), ("RECOVERED_PROVENANCE", "run 3", "recovered"), ("UNKNOWN_TYPE", "run 1", "weird"),
    ]
