import csv
import json
import random
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runlake.sources import (
    append_records, collect_capped, csv_lines, csv_records, has_multiline_cells, json_friendly, list_files, read_cells, read_chosen_texts, read_membership, read_record_lines,
    read_segments, read_store, read_text_files, scan_report_csv, split_cells, text_chunks, with_identity, write_membership, write_result, write_store,
)
from runlake.sources.csvs import DIALECT


def test_scan_csv_by_position(spark, tmp_path, rows):
    f = tmp_path / "r.csv"
    f.write_text('student_id,score,ok,note\n1,2.5,TRUE,"a ""q"", b"\n2,,false,\n,7,,""\n')
    columns = {"score": "DOUBLE", "sid": "BIGINT", "ok": "BOOLEAN", "note": "VARCHAR", "zz": "VARCHAR"}
    df = scan_report_csv(spark, str(f), columns, ["sid", "score", "ok", "note"], 9)
    assert df.dtypes == [("run_id", "bigint"), ("sid", "bigint"), ("score", "double"), ("ok", "boolean"), ("note", "string"), ("zz", "string")]
    assert rows(df) == sorted([(9, 1, 2.5, True, 'a "q", b', None), (9, 2, None, False, None, None), (9, None, 7.0, None, None, None)], key=repr)


def test_line_breaks_in_cells(spark, tmp_path, rows):
    f, g = tmp_path / "m.csv", tmp_path / "s.csv"
    f.write_text('a,b\n"x\ny",1\nz,2\n')
    g.write_text('a,b\n"x ""y""",1\n')
    assert has_multiline_cells(spark, str(f)) and not has_multiline_cells(spark, str(g))
    assert rows(read_cells(spark, str(f))) == [("x\ny", "1"), ("z", "2")]
    assert rows(scan_report_csv(spark, str(f), {"a": "VARCHAR", "b": "BIGINT"}, ["a", "b"], 1), "a", "b") == [("x\ny", 1), ("z", 2)]
    assert rows(read_cells(spark, str(g))) == [('x "y"', "1")]


@pytest.fixture
def small_splits(spark):
    """A way to set how many bytes a split has; set back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_size(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_size
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize(("end", "size"), [("\n", 1000), ("\n", 100), ("\r\n", 1000)])
def test_line_breaks_in_splits(spark, tmp_path, rows, small_splits, end, size):
    r, want, paths = random.Random(1), [], [str(tmp_path / f"{i}.csv") for i in range(2)]
    pieces = ["a", "", "x\ny", "\n\n", 'q"q', '"', "\n", ",", 'é\n"",', "plain text " * 5, "\r\nz", " s "]
    for i, path in enumerate(paths):
        with open(path, "w", newline="") as out:
            write = csv.writer(out, lineterminator=end)
            write.writerow(["id", "t", "u"])
            for k in range(100):
                out.write(end if k == 50 else "")  # an empty line is no record
                row = [str(100 * i + k), "".join(r.choice(pieces) for _ in range(3)), r.choice(pieces)]
                if k == 70:
                    row[1] = "one\nlong\n" * 300  # over many splits
                write.writerow(row)
                want.append(tuple(x or None for x in row))
    small_splits(size)
    assert csv_lines(spark, paths).rdd.getNumPartitions() > 10
    assert rows(split_cells(spark, paths, ["id", "t", "u"], DIALECT)) == rows(read_cells(spark, paths)) == sorted(want, key=repr)
    scanned = scan_report_csv(spark, paths, {"n": "BIGINT", "t": "VARCHAR", "u": "VARCHAR", "none": "VARCHAR"}, ["n", "t", "u"], 3)
    assert rows(scanned) == sorted(((3, int(n), t, u, None) for n, t, u in want), key=repr)


def test_records_and_their_places(spark, tmp_path, small_splits):
    (tmp_path / "r.csv").write_text('a,b\n"x\n\ny",1\n\n"u",2\n"open,3\nmore')
    for size in (1000, 3):
        small_splits(size)
        found = csv_records(csv_lines(spark, str(tmp_path / "r.csv"))).orderBy("split", "at").collect()
        assert [(r.record, r.closed) for r in found] == [("a,b", True), ('"x\n\ny",1', True), ("", True), ('"u",2', True), ('"open,3\nmore', False)]


@pytest.mark.parametrize(
    ("text", "want"),
    [('a,b\nx"y,1\n"u\nv",2\n', [("u\nv", "2"), ('x"y', "1")]), ('a,b\n"u\nv",2\n"w,3\n', [("u\nv", "2"), ("w,3\n", None)])],
)
def test_quotes_that_do_not_tell_are_read_from_the_start(spark, tmp_path, rows, text, want):
    (tmp_path / "r.csv").write_text(text)
    assert split_cells(spark, str(tmp_path / "r.csv"), ["a", "b"], DIALECT) is None
    assert rows(read_cells(spark, str(tmp_path / "r.csv"))) == want


def test_header_without_records_and_other_escapes(spark, tmp_path, rows):
    (tmp_path / "h.csv").write_text('"a\nb",c\n')
    (tmp_path / "e.csv").write_text('a;b\n"x\ny";1\n')
    (tmp_path / "none.csv").write_text("")
    assert rows(read_cells(spark, str(tmp_path / "h.csv"))) == [] and read_cells(spark, str(tmp_path / "h.csv")).columns == ["a\nb", "c"]
    assert rows(split_cells(spark, str(tmp_path / "none.csv"), ["a"], DIALECT)) == []
    semicolons = {"delim": ";", "quote": '"', "escape": '"'}
    assert rows(split_cells(spark, str(tmp_path / "e.csv"), ["a", "b"], semicolons)) == [("x\ny", "1")]
    assert split_cells(spark, str(tmp_path / "e.csv"), ["a", "b"], semicolons | {"escape": "\\"}) is None


def test_records_append_and_position(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "p1.jsonl").write_text('{"source_key":"s","remote_endpoint":"e","question_id":"q","n":1}\n\n{"source_key":"s","remote_endpoint":"e","n":2}\n')
    lines = with_identity(read_record_lines(spark, str(pages)), "answers")
    assert [(r.question_id, json.loads(r.record)["n"]) for r in lines.orderBy("_position").collect()] == [("q", 1), ("", 2)]
    at = F.lit("2024-05-01 10:00:00.75").cast("timestamp")
    for _ in range(2):  # delivering a batch again changes nothing
        append_records(lines, str(tmp_path / "seg"), at, 7, "0002")
    append_records(lines, str(tmp_path / "seg"), at, 7, "0010")
    got = read_segments(spark, str(tmp_path / "seg"), [7])
    assert got.count() == 4 and {r._fetched_at for r in got.collect()} == {datetime(2024, 5, 1, 10, 0, 0)}
    assert [r._position._batch for r in got.orderBy("_position").collect()] == ["0002", "0002", "0010", "0010"]


@pytest.mark.parametrize("record", ['{"source_key":5}', "[1]", "{"])
def test_bad_identity_is_an_error(spark, record):
    df = spark.createDataFrame([(record,)], "record string")
    with pytest.raises(Exception, match="identity field|no JSON object"):
        with_identity(df, "answers").collect()


def test_membership_roundtrip(spark, tmp_path, rows):
    m = spark.createDataFrame([("answers", 1, "s", "e", "q", ""), ("history", 2, "s", "e", "q", "h")], "type string, run_id bigint, source_key string, remote_endpoint string, question_id string, history_id string")
    write_membership(m, str(tmp_path / "m"))
    text = next((tmp_path / "m/type=answers/run_id=1").glob("*.json")).read_text()
    assert json.loads(text) == {"source_key": "s", "remote_endpoint": "e", "question_id": "q"}
    assert rows(read_membership(spark, str(tmp_path / "m"))) == [("answers", 1, "s", "e", "q", None), ("history", 2, "s", "e", "q", "h")]


def test_store_files_are_ordered(spark, tmp_path):
    df = spark.range(1000).select(F.lit("s").alias("source_key"), F.concat(F.lit("e"), F.col("id") % 317).alias("remote_endpoint"), F.col("id").cast("string").alias("question_id"), "id")
    write_store(df, str(tmp_path / "v"), "answers")
    got = [(r.source_key, r.remote_endpoint, r.question_id) for r in read_store(spark, str(tmp_path / "v")).collect()]
    key = [b"".join(b"%d:%s" % (len(f.encode()), f.encode()) for f in k) for k in got]
    assert len(key) == 1000 and key == sorted(key)


def test_ndjson_store(spark, tmp_path, rows):
    (tmp_path / "s.jsonl").write_text('{"n":1,"j":{"a":1.0}}\n{"n":2,"j":null}\n')
    assert rows(read_store(spark, str(tmp_path / "s.jsonl"), {"n": "BIGINT", "j": "JSON"})) == [(1, '{"a":1}'), (2, None)]


def test_files(spark, tmp_path, rows):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text("{é\n}")
    (tmp_path / "y.mp3").write_bytes(b"\xff\xfe\x00")
    assert rows(list_files(spark, str(tmp_path)), "file", "size") == [("x.json", 5), ("y.mp3", 3)]
    assert rows(read_text_files(spark, str(tmp_path)), "file", "content") == [("x.json", "{é\n}")]


def test_text_files_above_the_limit_have_a_reason(spark, tmp_path, rows):
    (tmp_path / "small.txt").write_text("abc")
    (tmp_path / "large.txt").write_text("abcdefgh")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5")
    try:
        found = rows(read_text_files(spark, str(tmp_path)), "file", "content", "reason")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == [("large.txt", None, "8 bytes, more than the limit of 5"), ("small.txt", "abc", None)]


def test_only_chosen_files_are_opened(spark, tmp_path, rows):
    texts = {"x y.json": "{é\\n}", "empty.txt": "", "long.txt": "aé€😀" * 50, "tail.txt": "ab" * 8}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "late.txt").write_bytes(b"a" * 40 + b"\xff")
    (tmp_path / "cut.txt").write_bytes("€".encode()[:2])
    files = list_files(spark, str(tmp_path)).collect()
    gone = spark.createDataFrame(files, "file string, path string, size bigint")
    gone = gone.union(spark.createDataFrame([(n, f"file:{tmp_path}/{n}", k) for n, k in (("song.mp3", 3), ("empty.txt", 0))]))  # Spark lists no empty files
    # The file that is not there would fail if it were opened.
    chosen = gone.where("file <> 'song.mp3'")
    assert rows(read_chosen_texts(chosen), "file", "content", "reason") == sorted(((n, t, None) for n, t in texts.items()), key=repr)
    for size in (7, 16, 1000):
        found = {}
        for r in text_chunks(chosen, size).orderBy("file", "chunk").collect():
            found.setdefault(r.file, []).append(r.content)
        assert {n: "".join(c) for n, c in found.items()} == texts
        assert all(len(c) == max(1, -(-len(texts[n].encode()) // size)) for n, c in found.items())
    with pytest.raises(Exception, match="song.mp3"):
        read_chosen_texts(gone).collect()
    assert rows(read_chosen_texts(chosen.limit(0))) == []


def test_chosen_texts_above_the_limit_have_a_reason(spark, tmp_path, rows):
    (tmp_path / "small.txt").write_text("abc")
    (tmp_path / "large.txt").write_text("abcdefgh")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5")
    try:
        found = rows(read_chosen_texts(list_files(spark, str(tmp_path))), "file", "content", "reason")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == [("large.txt", None, "8 bytes, more than the limit of 5"), ("small.txt", "abc", None)]
    assert [r.content for r in text_chunks(list_files(spark, str(tmp_path)).where("file = 'large.txt'"), 5).orderBy("chunk").collect()] == ["abcde", "fgh"]


def result(spark):
    return spark.createDataFrame(
        [(1, 1.5, float("nan"), Decimal("0.10"), Decimal(2) ** 70, datetime(2024, 1, 1, 0, 0, 1, 500000, tzinfo=timezone.utc), date(2024, 1, 2), bytearray(b"hi"), None, 'a "q", b', True),
         (2, float("inf"), float("-inf"), Decimal("0.50"), Decimal(7), None, None, None, None, "", False)],
        "i bigint, d double, n double, e decimal(10,2), w decimal(38,0), ts timestamp, day date, b binary, z string, s string, f boolean",
    )


def test_json_friendly(spark):
    _, got, truncated, total = collect_capped(result(spark).orderBy("i"))
    assert (truncated, total) == (False, 2)
    assert got[0] == {"i": 1, "d": 1.5, "n": "NaN", "e": "0.1", "w": str(2**70), "ts": "2024-01-01T00:00:01.5Z", "day": "2024-01-02T00:00:00Z", "b": "hi", "z": None, "s": 'a "q", b', "f": True}
    assert (got[1]["d"], got[1]["n"], got[1]["e"], got[1]["w"], got[1]["ts"]) == ("+Inf", "-Inf", 0.5, 7, None)


def test_capped(spark):
    columns, got, truncated, total = collect_capped(spark.range(25), 10)
    assert (columns, len(got), truncated, total) == (["id"], 10, True, 25)
    assert collect_capped(spark.range(10), 10)[2:] == (False, 10)


def text_of(folder, pattern):
    return "".join(p.read_text() for p in sorted(folder.glob(pattern)))


def test_export(spark, tmp_path):
    df = result(spark).orderBy("i").coalesce(1)
    write_result(df, str(tmp_path / "c"), "csv")
    assert text_of(tmp_path / "c", "*.csv").splitlines()[:2] == ["i,d,n,e,w,ts,day,b,z,s,f", f'1,1.5,NaN,0.1,{2**70},2024-01-01T00:00:01.5Z,2024-01-02T00:00:00Z,hi,,"a ""q"", b",true']
    write_result(df, str(tmp_path / "l"), "jsonl")
    lines = [json.loads(x) for x in text_of(tmp_path / "l", "*.json").splitlines()]
    assert [x["i"] for x in lines] == [1, 2] and lines[0]["z"] is None
    write_result(df, str(tmp_path / "j"), "json")
    assert json.loads(text_of(tmp_path / "j", "*.txt")) == lines
    write_result(df.where("false"), str(tmp_path / "e"), "json")
    assert json.loads(text_of(tmp_path / "e", "*.txt")) == []
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "x"), "xml")


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_file_names_are_split_once_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for page, lines in (("page-10.json", ["e", "", "f"]), ("page-2.json", ["c", "  ", "d"]), ("page-1.json", ["a", "b"])):
        (tmp_path / "in" / page).write_text("\n".join(lines) + "\n")
    found = read_record_lines(spark, str(tmp_path / "in"))
    assert [r["record"] for r in found.orderBy("_position").collect()] == list("abcdef")
    assert found.select("_position.file").distinct().count() == 3
    plan = _optimized(found)
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("regexp_extract_all")


def test_a_record_is_parsed_once_for_its_identity(spark):
    rows = [(' {"source_key":"a","remote_endpoint":null}',), ('\t{"source_key":"b","question_id":"q"} ',)]
    found = with_identity(spark.createDataFrame(rows, "record string"), "answers")
    assert found.columns == ["record", "source_key", "remote_endpoint", "question_id"]
    assert sorted(tuple(r)[1:] for r in found.collect()) == [("a", "", ""), ("b", "", "q")]
    assert _optimized(found).count("parseJson") + _optimized(found).count("parse_json") == 1
    for text in ("null", "[1]", '"{"', "{", "", "\u00a0{}"):
        with pytest.raises(Exception, match="no JSON object"):
            with_identity(spark.createDataFrame([(text,)], "record string"), "answers").collect()
