"""Report rows, unions, type inference and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import filter_labels, is_text_content_type, report_type_from_slug, state_text, try_number
from runlake.operators import (
    answers_long, answers_long_of_runs, attach_learner, correct_counts, data_row_count, double_decode, infer_csv_schema,
    infer_json_columns, quarantine, recover_report_type, report_prompts, report_rows, reports_to_answers,
    union_runs,
)
from runlake.sources import type_records

from . import shapes as S
from .record_queries import _all_runs
from .registry import query


def _runs(spark, sf):
    return {
        1: (S.report_run_1(spark, sf), "answers"),
        2: (S.report_run_2(spark, sf), "usage"),
        3: (S.report_run_3(spark, sf), "coursework"),
    }


@query(f"""
WITH {S.RUN_1}
SELECT CAST(1 AS BIGINT) AS run_id, * FROM run1 WHERE student_id NOT IN ('Prompt', 'Correct answer')
UNION ALL BY NAME
SELECT CAST(2 AS BIGINT) AS run_id, s_suppkey AS student_id, CAST(s_nationkey AS BIGINT) AS logins FROM supplier""")
def reports_union(spark, sf):
    """Text and numeric ids united, the unknown type left out."""
    return union_runs(_runs(spark, sf))


@query("""
SELECT CAST(1 AS BIGINT) AS run_id, CASE c_custkey % 50 WHEN 0 THEN 'Prompt' ELSE 'Correct answer' END AS student_id, CAST(c_acctbal AS VARCHAR) AS res_1_q1_answer
FROM customer WHERE c_custkey % 50 IN (0, 1)""")
def reports_prompts(spark, sf):
    """B2: pseudo-header rows strewn among the customers."""
    key = F.col("c_custkey")
    student = F.when(key % 50 == 0, "Prompt").when(key % 50 == 1, "Correct answer").otherwise(key.cast("string"))
    report = S.table(spark, sf, "customer").select(student.alias("student_id"), F.col("c_acctbal").cast("string").alias("res_1_q1_answer"))
    return union_runs({1: (report, "answers"), 2: (S.report_run_2(spark, sf), "usage")}, prompts=True)


@query(f"WITH {S.RUN_1} SELECT * FROM run1 WHERE student_id NOT IN ('Prompt', 'Correct answer')")
def report_run_rows(spark, sf):
    """B1 on one run."""
    return report_rows(S.report_run_1(spark, sf), "answers")


@query(f"""
WITH {S.RUN_1}
SELECT 'run1' AS report, count(*) - 2 AS row_count FROM run1 UNION ALL SELECT 'run2', count(*) FROM supplier""")
def report_row_counts(spark, sf):
    """Rows without a student id count."""
    counts = {"run1": data_row_count(S.report_run_1(spark, sf), "answers"), "run2": data_row_count(S.report_run_2(spark, sf), "usage")}
    return S.union_all([df.select(F.lit(n).alias("report"), "*") for n, df in counts.items()])


@query(f"""
WITH {S.DOWNLOADS}
SELECT run_id, report_type FROM downloads WHERE report_type NOT IN ('answers', 'usage', 'log', 'recovered')""")
def quarantined_runs(spark, sf):
    """B3."""
    return quarantine(S.downloads(spark, sf))[1].select("run_id", "report_type")


@query("""
SELECT 'customers' AS report, CASE WHEN count(*) > 0 THEN 'answers' END AS report_type, false AS recovered FROM customer
UNION ALL SELECT 'suppliers', CASE WHEN count(*) > 0 THEN 'recovered' END, true FROM supplier
UNION ALL SELECT 'events', CASE WHEN count(*) > 0 THEN 'log' END, false FROM events""")
def recovered_report_types(spark, sf):
    """B5."""
    suppliers = S.report_run_2(spark, sf).withColumn("student_id", F.col("student_id").cast("string"))
    frames = {"customers": S.report_run_1(spark, sf), "suppliers": suppliers, "events": S.table(spark, sf, "events")}
    return S.union_all([recover_report_type(df).select(F.lit(n).alias("report"), "*") for n, df in frames.items()])


SLUG = """CASE o_orderkey % 7 WHEN 0 THEN 'student-answers' WHEN 1 THEN 'student-assignment-usage' WHEN 2 THEN 'student-actions'
 WHEN 3 THEN 'student-actions-with-metadata' WHEN 4 THEN 'teacher-actions' ELSE o_orderpriority END"""


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'usage' ELSE
  CASE o_orderkey % 7 WHEN 0 THEN 'answers' WHEN 1 THEN 'usage' WHEN 2 THEN 'log' WHEN 3 THEN 'log' WHEN 4 THEN 'log'
  ELSE o_orderpriority END END AS report_type FROM orders""")
def report_type_lookup(spark, sf):
    """B4."""
    o = S.table(spark, sf, "orders")
    server = F.when(F.col("o_orderstatus") == "P", "usage").when(F.col("o_orderstatus") == "O", "")
    return o.select("o_orderkey", report_type_from_slug(F.expr(SLUG), server).alias("report_type"))


@query("""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Text/' || lang WHEN 1 THEN 'application/JSON; charset=' || lang
  WHEN 2 THEN 'image/svg+xml' WHEN 3 THEN 'audio/' || lang WHEN 4 THEN '' END AS content_type FROM documents)
SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS is_text FROM t""")
def text_content_types(spark, sf):
    """B6."""
    d = S.table(spark, sf, "documents")
    way = F.col("doc_id") % 6
    ct = (
        F.when(way == 0, F.concat(F.lit("Text/"), "lang"))
        .when(way == 1, F.concat(F.lit("application/JSON; charset="), "lang"))
        .when(way == 2, "image/svg+xml").when(way == 3, F.concat(F.lit("audio/"), "lang")).when(way == 4, "")
    )
    return d.select("doc_id", is_text_content_type(ct).alias("is_text"))


@query(f"WITH {S.LONG} SELECT * FROM long")
def reports_long(spark, sf):
    """Positional columns as rows."""
    return answers_long(S.positional_report(spark, sf))


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}, {S.LONG}
SELECT l.student_id, l.n, l.question_id, l.remote_endpoint, l.answer, d2.source_key, d2.event_id
FROM long l JOIN d2 USING (remote_endpoint, question_id)""")
def reports_answers_join(spark, sf):
    """Report cells joined to stored answers."""
    store, _ = _all_runs(spark, sf)
    rows = reports_to_answers(answers_long(S.positional_report(spark, sf)), store)
    return rows.select("student_id", "n", "question_id", "remote_endpoint", "answer", "source_key", "event_id")


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT {S.KEYS}, event_id, c_custkey AS learner FROM d2 LEFT JOIN customer ON remote_endpoint = 'u' || c_custkey""")
def learners_attached(spark, sf):
    """C6."""
    store, _ = _all_runs(spark, sf)
    reports = S.positional_report(spark, sf).select(F.col("user_id").alias("learner"), "res_1_remote_endpoint")
    return attach_learner(store, reports, ["learner"]).select(
        "source_key", "remote_endpoint", "question_id", "event_id", "learner"
    )


@query(f"""
WITH {S.LONG}
SELECT question_id, count(answer) AS answered, count(*) FILTER (WHERE answer = 'BUILDING') AS correct
FROM long WHERE question_id = 'q1' GROUP BY question_id""")
def correct_answers(spark, sf):
    """Answers equal to the prompt row's correct answer."""
    long = answers_long(S.positional_report(spark, sf))
    prompts = report_prompts(S.report_run_1(spark, sf), "answers").where(F.col("student_id") == "Correct answer")
    correct = prompts.select(F.lit("q1").alias("question_id"), F.col("res_1_q2_answer").alias("correct"))
    return correct_counts(long, correct, ["question_id"])


@query(f"""
WITH {S.CELLS}, long AS (FROM cells UNPIVOT INCLUDE NULLS (cell FOR "column" IN (COLUMNS(*)))),
kinds AS (SELECT "column", CASE WHEN cell IS NULL OR cell = '' THEN NULL
  WHEN regexp_full_match(cell, '[+-]?[0-9]+') AND TRY_CAST(cell AS BIGINT) IS NOT NULL THEN 'BIGINT'
  WHEN regexp_full_match(cell, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(coalesce(TRY_CAST(cell AS DOUBLE), 'inf'::DOUBLE)) THEN 'DOUBLE'
  WHEN lower(cell) IN ('inf', 'nan', '0x1p-2') THEN 'DOUBLE'
  WHEN lower(cell) IN ('true', 'false') THEN 'BOOLEAN' ELSE 'VARCHAR' END AS kind FROM long)
SELECT "column", CASE WHEN count(DISTINCT kind) = 1 THEN min(kind)
  WHEN count(DISTINCT kind) = 2 AND min(kind) = 'BIGINT' AND max(kind) = 'DOUBLE' THEN 'DOUBLE' ELSE 'VARCHAR' END AS type
FROM kinds GROUP BY "column\"""")
def csv_schema_inference(spark, sf):
    """A2 over every line item."""
    return infer_csv_schema(S.text_cells(spark, sf)).select("column", "type")


JSON_KINDS = """
SELECT column_name AS "column", CASE WHEN count(kind) = 0 THEN 'VARCHAR' WHEN count(DISTINCT kind) = 1 THEN min(kind)
  WHEN count(DISTINCT kind) = 2 AND min(kind) = 'BIGINT' AND max(kind) = 'DOUBLE' THEN 'DOUBLE' ELSE 'JSON' END AS type
FROM (
  SELECT j.key AS column_name, CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN 'JSON' WHEN j.type = 'VARCHAR' THEN 'VARCHAR'
    WHEN j.type = 'BOOLEAN' THEN 'BOOLEAN' WHEN j.type = 'NULL' THEN NULL
    WHEN j.type IN ('BIGINT', 'UBIGINT') AND TRY_CAST(j.value AS BIGINT) IS NOT NULL THEN 'BIGINT' ELSE 'DOUBLE' END AS kind
  FROM json_records, json_each(record) j)
GROUP BY column_name"""
PINNED = """(VALUES ('source_key','VARCHAR'), ('remote_endpoint','VARCHAR'), ('question_id','VARCHAR'), ('history_id','VARCHAR'),
  ('_fetched_at','TIMESTAMP'), ('_run_id','BIGINT'), ('_decode_error','BOOLEAN'), ('report_state','JSON'),
  ('report_state_raw','VARCHAR'), ('interactive_state_raw','VARCHAR'), ('answer','JSON')) p("column", type)"""


@query(f"""
WITH {S.EV}, {S.JSON_RECORDS}, seen AS ({JSON_KINDS}), pinned AS (SELECT * FROM {PINNED})
SELECT * FROM pinned UNION ALL SELECT * FROM seen WHERE "column" NOT IN (SELECT "column" FROM pinned)""")
def json_column_inference(spark, sf):
    """A4 over every event record."""
    return infer_json_columns(S.json_records(spark, sf))


@query(f"""
WITH {S.EV}, {S.JSON_RECORDS}
SELECT event_id, json_extract_string(record, '$.source_key') AS source_key,
       CAST(json_extract(record, '$.value') AS DOUBLE) AS value, CAST(json_extract(record, '$.int_or_float') AS DOUBLE) AS int_or_float,
       CAST(json_extract(record, '$.flag_or_null') AS BOOLEAN) AS flag_or_null, CAST(json_extract(record, '$.mixed') AS VARCHAR) AS mixed,
       CAST(json_extract_string(record, '$.props.k') AS BIGINT) AS props_k, CAST(NULL AS VARCHAR) AS remote_endpoint
FROM json_records""")
def typed_records(spark, sf):
    """A3: record text read with a column map; a quoted scalar in a JSON column keeps its quotes."""
    columns = {
        "source_key": "VARCHAR", "value": "DOUBLE", "int_or_float": "DOUBLE", "flag_or_null": "BOOLEAN",
        "mixed": "JSON", "props": "JSON", "remote_endpoint": "VARCHAR",
    }
    rows = type_records(S.json_records(spark, sf), columns, keep=["event_id"])
    return rows.withColumn("props_k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


@query(f"""
WITH {S.EV}, {S.ENCODED}
SELECT event_id,
  CASE WHEN outer_text IS NULL AND state IS NULL THEN NULL WHEN outer_text IS NULL THEN 'as is' WHEN outer_json IS NULL THEN NULL ELSE 'decoded' END AS how,
  CASE WHEN outer_text IS NULL THEN CAST(json_extract_string(state, '$.v') AS BIGINT) ELSE CAST(json_extract_string(outer_json, '$.v') AS BIGINT) END AS v,
  CASE WHEN json_type(inner_json) = 'OBJECT' THEN json_extract_string(inner_json, '$.answer') END AS answer,
  CASE WHEN outer_text IS NOT NULL AND outer_json IS NULL THEN outer_text END AS report_state_raw,
  CASE WHEN inner_text IS NOT NULL AND (inner_json IS NULL OR json_type(inner_json) <> 'OBJECT') THEN inner_text END AS interactive_state_raw,
  (outer_text IS NOT NULL AND outer_json IS NULL) OR (inner_text IS NOT NULL AND (inner_json IS NULL OR json_type(inner_json) <> 'OBJECT')) AS decode_error
FROM decoded""")
def decoded_states(spark, sf):
    """A9."""
    d = double_decode(S.encoded_records(spark, sf))
    state = F.col("report_state")
    return d.select(
        "event_id",
        F.when(state.isNull(), F.lit(None)).when(F.col("event_id") % 7 == 3, "as is").otherwise("decoded").alias("how"),
        F.get_json_object(state, "$.v").cast("bigint").alias("v"),
        F.get_json_object(state, "$.interactiveState.answer").alias("answer"),
        "report_state_raw", "interactive_state_raw",
        F.coalesce("_decode_error", F.lit(False)).alias("decode_error"),
    )


@query("""
SELECT c_custkey, 'assignment: T' || c_nationkey || '/' || c_mktsegment || '|class: ' || c_mktsegment
  || '|n: ' || c_nationkey || '/2.5/true|teacher: ' || c_name || '/T' || c_nationkey AS labels, CAST(4 AS BIGINT) AS n_labels
FROM customer""")
def filter_label_texts(spark, sf):
    """Nested lists and id-to-label maps."""
    c = S.table(spark, sf, "customer")
    nation = F.col("c_nationkey").cast("string")
    filters = F.concat(
        F.lit('{"teacher":["'), "c_name", F.lit('","","T'), nation, F.lit('"],"class":"'), "c_mktsegment",
        F.lit('","school":null,"none":[],"assignment":{"9":"'), "c_mktsegment", F.lit('","14":"T'), nation,
        F.lit('"},"n":['), nation, F.lit(",2.5,true]}"),
    )
    labels = filter_labels(filters)
    return c.select("c_custkey", F.array_join(labels, "|").alias("labels"), F.size(labels).cast("bigint").alias("n_labels"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '(none)' WHEN o_orderstatus = 'P' THEN '(none)' ELSE o_orderpriority END AS state FROM orders""")
def state_texts(spark, sf):
    """H12."""
    o = S.table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
    return o.select("o_orderkey", state_text(state).alias("state"))


@query(f"""
WITH {S.RUN_1}
SELECT count(TRY_CAST(res_1_q1_answer AS DOUBLE)) AS numbers, round(sum(TRY_CAST(res_1_q1_answer AS DOUBLE)), 2) AS total FROM run1""")
def numeric_answers(spark, sf):
    """Prompt text among numbers."""
    number = try_number(F.col("res_1_q1_answer"))
    return S.report_run_1(spark, sf).agg(F.count(number).alias("numbers"), F.round(F.sum(number), 2).alias("total"))


@query("""
SELECT CAST(1 AS BIGINT) AS run_id, CAST(c_custkey AS VARCHAR) AS student_id, CAST(1 AS BIGINT) AS n, 'u' || c_custkey AS remote_endpoint, 'q1' AS question_id, c_mktsegment AS answer FROM customer
UNION ALL SELECT 2, CAST(s_suppkey AS VARCHAR), 1, 's' || s_suppkey, 'q9', s_name FROM supplier
UNION ALL SELECT 3, CAST(p_partkey AS VARCHAR), x.n, CASE x.n WHEN 1 THEN 'p' || p_partkey END, 'q' || x.n, CASE x.n WHEN 1 THEN p_brand ELSE p_type END FROM part, (VALUES (1), (2)) x(n)""")
def reports_long_of_runs(spark, sf):
    """C5 over three runs with different positional columns."""
    text = lambda c: F.col(c).cast("string")
    return answers_long_of_runs({
        1: S.table(spark, sf, "customer").select(
            text("c_custkey").alias("student_id"), F.concat(F.lit("u"), "c_custkey").alias("res_1_remote_endpoint"), F.col("c_mktsegment").alias("res_1_q1_answer")),
        2: S.table(spark, sf, "supplier").select(
            text("s_suppkey").alias("student_id"), F.concat(F.lit("s"), "s_suppkey").alias("res_1_remote_endpoint"), F.col("s_name").alias("res_1_q9_answer")),
        3: S.table(spark, sf, "part").select(
            text("p_partkey").alias("student_id"), F.concat(F.lit("p"), "p_partkey").alias("res_1_remote_endpoint"),
            F.col("p_brand").alias("res_1_q1_answer"), F.col("p_type").alias("res_2_q2_answer")),
    })


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')},
named AS (
  SELECT 'u' || (o_custkey % 200) AS remote_endpoint, CAST(o_orderkey % 3 AS BIGINT) AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS learner FROM orders),
best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY remote_endpoint ORDER BY learner IS NOT NULL DESC, run_id DESC, learner DESC) = 1)
SELECT {S.KEYS}, event_id, learner FROM d2 LEFT JOIN best USING (remote_endpoint)""")
def learners_of_repeated_endpoints(spark, sf):
    """An endpoint that many rows name, with and without an id, has one learner."""
    store, _ = _all_runs(spark, sf)
    key = F.col("o_orderkey")
    reports = S.table(spark, sf, "orders").select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 200).cast("string")).alias("res_1_remote_endpoint"), (key % 3).alias("run_id"),
        F.when(key % 4 != 0, F.col("o_custkey")).alias("learner"),
    )
    return attach_learner(store, reports, ["learner"]).select("source_key", "remote_endpoint", "question_id", "event_id", "learner")
