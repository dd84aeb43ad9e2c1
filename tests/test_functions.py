import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlake.functions import (
    file_id12, filter_labels, identity_key, is_json, is_text_content_type, json_get, json_items, report_type_from_slug,
    rfc3339, sanitize_filename, state_markers, state_text, try_json, try_number,
)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).head()[0]


def many(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", fn(F.col("v")).alias("o")).collect())]


def test_identity_key_is_injective(spark):
    tuples = [("a", "b", "c"), ("ab", "", "c"), ("a:b", "c", "d"), ("a", "b:c", "d"), ("", "", ""), ("\x00", "1:", "é"), ("é", "", "\x00")]
    df = spark.createDataFrame(tuples, "a string, b string, c string").select(identity_key("a", "b", "c").alias("k"))
    keys = [r.k for r in df.collect()]
    assert len(set(keys)) == len(tuples)
    assert "1:\x002:1:2:é" in keys  # lengths are bytes


def test_identity_key_counts_absent_as_empty(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert df.select(identity_key("a", "b")).head()[0] == "0:1:x"


def test_file_id(spark):
    import hashlib

    df = spark.createDataFrame([("s", "p/é")], "a string, b string")
    assert df.select(file_id12("a", "b")).head()[0] == hashlib.sha256("s|p/é".encode()).hexdigest()[:12]


@pytest.mark.parametrize("name, want", [
    ("plain.txt", "plain.txt"), ("a/b\\c.txt", "c.txt"), ("a:b", "a_b"), ("x?*|.txt", "x___.txt"), ("dots. . ", "dots"),
    ("CON.txt", "_CON.txt"), ("con", "_con"), ("console", "console"), ("", "_"), ("..", "_"), ("a/", "_"), ("日😀.txt", "__.txt"),
])
def test_sanitize_filename(spark, name, want):
    assert one(spark, name, sanitize_filename) == want


def test_state_markers(spark):
    doc = '{"a":{"__attachment__":"f.json"},"b":[{"__attach\\u006dent__":"q\\"x"}],"c":"\\"__attachment__\\": \\"no\\"","__attachment__":5}'
    assert sorted(many(spark, [doc, "bad{", None], state_markers)[0]) == ["f.json", 'q"x']
    assert many(spark, [doc, "bad{", None], state_markers)[1:] == [[], []]


def test_is_json_accepts_exactly_one_value(spark):
    good = ["1", " 3 ", '{"a":1}', "[1,2]", "null", '"x"', '{"a":1,"a":2}', "true"]
    bad = ["", "{", '{"a":1} x', "{'a':1}", "1,2", "1],[2", '{"a":1}}', "tru", "01", "1.", '"a\tb"']
    assert all(many(spark, good, is_json))
    assert not any(many(spark, bad, is_json))
    assert many(spark, ['{"a": 1.0}', "no"], try_json) == ['{"a": 1.0}', None]


def _walk(value):
    if isinstance(value, dict):
        for v in value.values():
            yield from _walk(v)
        if isinstance(value.get("__attachment__"), str):
            yield value["__attachment__"]
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=6) | st.just('"__attachment__": "x"'),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "__attachment__", "b\\", '"']), c, max_size=3),
    max_leaves=12), min_size=20, max_size=20))
def test_state_markers_match_a_tree_walk(spark, docs):
    texts = [json.dumps(d, ensure_ascii=i % 2 == 0) for i, d in enumerate(docs)]
    got = many(spark, texts, state_markers)
    assert [sorted(g) for g in got] == [sorted(set(_walk(d))) for d in docs]


def test_json_access(spark):
    assert many(spark, ['{"a":{"b":"x"}}'], lambda c: json_get(c, "$.a.b")) == ["x"]
    assert many(spark, ['[1,"a",{"b":null}]', "x"], json_items) == [["1", '"a"', '{"b":null}'], None]


def test_filter_labels(spark):
    filters = {
        "class": "Period 3", "teacher": ["Ms. A", "", "Mr. B"], "school": None, "assignment": {"573": "Demo", "12": "First: one"},
        "n": [1, 2.5, 1234567, 1e-5, 0.00012, True, 1e21, 123456], "empty": [],
    }
    assert one(spark, json.dumps(filters), filter_labels) == [
        "assignment: First: one/Demo", "class: Period 3", "n: 1/2.5/1.234567e+06/1e-05/0.00012/true/1e+21/123456", "teacher: Ms. A/Mr. B",
    ]
    assert one(spark, "{}", filter_labels) == []


def test_small_texts(spark):
    assert many(spark, [None, "", "running"], state_text) == ["(none)", "(none)", "running"]
    assert many(spark, [None, "", "TEXT/html", "application/vnd.api+JSON", "audio/mp3", "x-text/a"], is_text_content_type) == [
        False, False, True, True, False, False,
    ]
    assert many(spark, ["student-answers", "teacher-actions", "other", None], report_type_from_slug) == ["answers", "log", "other", None]
    df = spark.createDataFrame([("student-answers", "usage"), ("student-answers", "")], "s string, t string")
    assert [r[0] for r in df.select(report_type_from_slug(F.col("s"), F.col("t"))).collect()] == ["usage", "answers"]
    assert many(spark, ["1.5", "How much?", ""], try_number) == [1.5, None, None]


def test_rfc3339(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:10.500' a, timestamp'2024-01-01 00:00:10' b")
    assert tuple(df.select(rfc3339(F.col("a")), rfc3339(F.col("b"))).head()) == ("2024-01-01T00:00:10.5Z", "2024-01-01T00:00:10Z")
