import json

from pyspark.sql import functions as F

from runlake.operators import data_row_count, double_decode, infer_csv_schema, infer_json_columns
from runlake.operators.inference import PINNED, common_type
from runlake.sources import type_records, typed_empty


def csv_types(spark, rows, columns):
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))
    out = infer_csv_schema(df).orderBy("position").collect()
    assert [r["column"] for r in out] == list(columns)
    return {r["column"]: r["type"] for r in out}


def test_csv_widening(spark):
    cells = {
        "i": ["1", "-2", ""], "f": ["1", "2.5", None], "b": ["TRUE", "false", ""], "ib": ["1", "true", ""], "e": ["", None, ""],
        "big": ["9223372036854775807", "9223372036854775808", ""], "sp": [" 5", "5", ""], "d": ["5d", "5", ""], "inf": ["-Inf", "nan", ""],
        "hex": ["0x1p-2", "0X1.8P3", ""], "over": ["1e999", "1", ""], "dot": [".5", "5.", ""], "under": ["1_000", "1", ""], "plus": ["+5", "1e3", ""],
    }
    types = csv_types(spark, list(zip(*cells.values())), cells)
    assert types == {
        "i": "BIGINT", "f": "DOUBLE", "b": "BOOLEAN", "ib": "VARCHAR", "e": "VARCHAR", "big": "DOUBLE", "sp": "VARCHAR", "d": "VARCHAR",
        "inf": "DOUBLE", "hex": "DOUBLE", "over": "VARCHAR", "dot": "DOUBLE", "under": "VARCHAR", "plus": "DOUBLE",
    }


def test_row_count_keeps_rows_without_student(spark):
    df = spark.createDataFrame([("Prompt",), ("Correct answer",), ("1",), (None,)], "student_id string")
    assert data_row_count(df, "answers").head()[0] == 2
    assert data_row_count(df, "usage").head()[0] == 4


def json_types(spark, *records, pinned=False):
    df = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "record string")
    return {r["column"]: r["type"] for r in infer_json_columns(df, pinned=pinned).collect()}


def test_json_widening(spark):
    assert json_types(spark, {"n": 1, "mix": 1, "maybe": None, "o": {}, "on": [1]}, {"n": 2.5, "mix": "t", "o": {"a": 1}, "on": 5}) == {
        "n": "DOUBLE", "mix": "JSON", "maybe": "VARCHAR", "o": "JSON", "on": "JSON",
    }
    assert json_types(spark, '{"a":1.0,"b":1e3,"c":12345678901234567890,"d":-5,"e":true,"f":"x","g":9223372036854775807}') == {
        "a": "DOUBLE", "b": "DOUBLE", "c": "DOUBLE", "d": "BIGINT", "e": "BOOLEAN", "f": "VARCHAR", "g": "BIGINT",
    }
    assert json_types(spark, "[1]", "nope") == {}


def test_pinned_columns_always_present(spark):
    got = json_types(spark, {"source_key": 5, "answer": 1, "score": 2}, pinned=True)
    assert got == {**PINNED, "score": "BIGINT"}


def test_typed_records(spark):
    lines = ['{"n":1,"j":"q","t":"x"}', '{"n":2.5,"j":null,"t":null}', '{"j":{"a":[1]},"b":true}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, record string")
    out = type_records(df, {"n": "DOUBLE", "j": "JSON", "t": "VARCHAR", "b": "BOOLEAN", "gone": "BIGINT"}, keep=["i"])
    assert [tuple(r) for r in out.orderBy("i").collect()] == [
        (0, 1.0, '"q"', "x", None, None), (1, 2.5, None, None, None, None), (2, None, '{"a":[1]}', None, True, None),
    ]


def test_fields_that_differ_in_case_only(spark, tmp_path):
    df = spark.createDataFrame([('{"Name":"a","name":5,"NAME":[1],"x":1}',)], "record string")
    out = type_records(df, {"NAME": "JSON", "Name": "VARCHAR", "name": "BIGINT", "x": "BIGINT"})
    out.write.parquet(str(tmp_path / "p"))
    row = spark.read.parquet(str(tmp_path / "p")).head().asDict()
    assert row == {"NAME": "[1]", "Name__2": "a", "name__3": 5, "x": 1}


def test_typed_empty(spark):
    df = typed_empty(spark, {"a b": "JSON", "n": "DOUBLE", "t": "TIMESTAMP"})
    assert df.dtypes == [("a b", "string"), ("n", "double"), ("t", "timestamp")] and df.count() == 0


def test_common_type():
    assert common_type({"bigint", "double"}) == "double"
    assert common_type({"boolean", "bigint"}) == "bigint"
    assert common_type({"string", "bigint"}) == "string"


def decode(spark, record):
    df = spark.createDataFrame([(record if isinstance(record, str) else json.dumps(record),)], "record string")
    row = double_decode(df).head().asDict()
    assert row.pop("record") == (record if isinstance(record, str) else json.dumps(record))
    state = row.pop("report_state")
    return (None if state is None else json.loads(state)), {k: v for k, v in row.items() if v is not None}


def test_decode_good(spark):
    state = json.dumps({"interactiveState": json.dumps({"answer": "42"}), "v": 1.5})
    assert decode(spark, {"question_id": "q1", "report_state": state}) == ({"interactiveState": {"answer": "42"}, "v": 1.5}, {})


def test_decode_outer_fails(spark):
    for bad in ("not json{", '{"a":1} x', "[1]", "5", ""):
        assert decode(spark, {"report_state": bad}) == (None, {"report_state_raw": bad, "_decode_error": True})
    # JSON null decodes to empty text, which is no JSON.
    assert decode(spark, {"report_state": None}) == (None, {"report_state_raw": "", "_decode_error": True})


def test_decode_inner_fails(spark):
    for bad in ("bad json{", "[1]", '"x"', ""):
        got = decode(spark, {"report_state": json.dumps({"interactiveState": bad, "k": 1})})
        assert got == ({"interactiveState": None, "k": 1}, {"interactive_state_raw": bad, "_decode_error": True})
    got = decode(spark, {"report_state": json.dumps({"interactiveState": None})})
    assert got == ({"interactiveState": None}, {"interactive_state_raw": "", "_decode_error": True})


def test_decode_leaves_the_rest_alone(spark):
    assert decode(spark, {"question_id": "q"}) == (None, {})
    assert decode(spark, {"report_state": {"a": 1}}) == ({"a": 1}, {})
    assert decode(spark, {"report_state": json.dumps({"k": 1})}) == ({"k": 1}, {})
    assert decode(spark, {"report_state": json.dumps({"interactiveState": {"already": "decoded"}})}) == ({"interactiveState": {"already": "decoded"}}, {})
    assert decode(spark, {"report_state": "null"}) == (None, {})
    assert decode(spark, {"report_state": json.dumps({"interactiveState": "null"})}) == ({"interactiveState": None}, {})
    assert decode(spark, "no record") == (None, {})


def test_inference_is_one_aggregate(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    plan = infer_csv_schema(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_bit_or" in plan and "SortAggregate" not in plan
