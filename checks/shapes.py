"""The driver tables reshaped as records, reports, attachments and manifests.

Each shape exists twice: as a Spark frame and as a DuckDB CTE of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions import attachment_file
from runlake.operators import attachment_refs

SHRUNK_FROM = 20.0  # a later fetch of run 501 returns only records of at least this value


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- events as answer, history and log records ------------------------------------------


def ev(spark: SparkSession, sf: str) -> DataFrame:
    return ev_of(table(spark, sf, "events"))


def ev_of(e: DataFrame) -> DataFrame:
    """Events, batch or stream, as answer and history records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_type").alias("source_key"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("remote_endpoint"),
        F.concat(F.lit("q"), (k % 4).cast("string")).alias("question_id"),
        F.col("event_id").cast("string").alias("history_id"),
        (F.lit(500) + F.col("event_id") % 3).cast("bigint").alias("_run_id"),
        F.col("ts").cast("timestamp").alias("_fetched_at"),
        "event_id", "user_id", "event_type", "value", "props", k.alias("k"),
    )


EV = """ev AS (
  SELECT event_type AS source_key, 'u' || user_id AS remote_endpoint,
         'q' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS question_id,
         CAST(event_id AS VARCHAR) AS history_id, CAST(500 + event_id % 3 AS BIGINT) AS _run_id,
         ts AS _fetched_at, event_id, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""

KEYS = "source_key, remote_endpoint, question_id"


def last_per_run(name: str, source: str, keys: str = KEYS) -> str:
    """CTE: the last record by position per run and identity."""
    return f"""{name} AS (
  SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY _run_id, {keys} ORDER BY event_id DESC) = 1)"""


def newest(name: str, source: str, keys: str = KEYS) -> str:
    """CTE: the newest record over runs per identity."""
    return f"""{name} AS (
  SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY _fetched_at DESC, _run_id DESC) = 1)"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("event"), "ts", "value", F.col("props").alias("extras"),
        F.unix_seconds(ts).alias("time"), F.unix_millis(ts).alias("timestamp"),
    )


GAPS = """gaps AS (
  SELECT event_id, user_id, event_type AS event, ts,
         lag(event_type) OVER w AS prev_event,
         epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_micros
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sessions AS (
  SELECT *, (gap_micros IS NULL OR gap_micros > 1800000000) AS new_session FROM gaps)"""


# ---- report runs ------------------------------------------------------------------------


def report_run_1(spark: SparkSession, sf: str) -> DataFrame:
    """An answers report: customers below two pseudo-header rows; some rows have no student."""
    c = table(spark, sf, "customer")
    rows = c.select(
        F.when(F.col("c_nationkey") != 0, F.col("c_custkey").cast("string")).alias("student_id"),
        F.col("c_acctbal").cast("string").alias("res_1_q1_answer"),
        F.col("c_mktsegment").alias("res_1_q2_answer"),
    )
    head = spark.createDataFrame(
        [("Prompt", "How much?", "Which one?"), ("Correct answer", None, "BUILDING")], rows.schema
    )
    return head.unionByName(rows)


def report_run_2(spark: SparkSession, sf: str) -> DataFrame:
    """A usage report: suppliers with a numeric student id."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("student_id"), F.col("s_nationkey").cast("bigint").alias("logins"))


def report_run_3(spark: SparkSession, sf: str) -> DataFrame:
    """A report of unknown type: parts."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("student_id"), F.col("p_size").cast("bigint").alias("y"))


RUN_1 = """run1 AS (
  SELECT 'Prompt' AS student_id, 'How much?' AS res_1_q1_answer, 'Which one?' AS res_1_q2_answer
  UNION ALL SELECT 'Correct answer', NULL, 'BUILDING'
  UNION ALL SELECT CASE WHEN c_nationkey <> 0 THEN CAST(c_custkey AS VARCHAR) END,
                   CAST(c_acctbal AS VARCHAR), c_mktsegment FROM customer)"""


def positional_report(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with two positional resources."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        F.lit(7).cast("bigint").alias("run_id"), key.alias("user_id"), key.cast("string").alias("student_id"),
        F.concat(F.lit("u"), key.cast("string")).alias("res_1_remote_endpoint"),
        F.lit("first").alias("res_1_name"),
        F.col("c_acctbal").cast("string").alias("res_1_q0_answer"),
        F.col("c_mktsegment").alias("res_1_q1_answer"),
        F.concat(F.lit("u"), (key + 1).cast("string")).alias("res_2_remote_endpoint"),
        F.lit("second").alias("res_2_name"),
        F.col("c_name").alias("res_2_q2_answer"),
    )


LONG = """long AS (
  SELECT CAST(7 AS BIGINT) AS run_id, CAST(c_custkey AS VARCHAR) AS student_id, CAST(1 AS BIGINT) AS n,
         'u' || c_custkey AS remote_endpoint, 'q0' AS question_id, CAST(c_acctbal AS VARCHAR) AS answer FROM customer
  UNION ALL SELECT 7, CAST(c_custkey AS VARCHAR), 1, 'u' || c_custkey, 'q1', c_mktsegment FROM customer
  UNION ALL SELECT 7, CAST(c_custkey AS VARCHAR), 2, 'u' || (c_custkey + 1), 'q2', c_name FROM customer)"""


def text_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as the cells of an all-text CSV, with columns of every kind."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    text = n.cast("string")
    return li.select(
        F.col("l_orderkey").cast("string").alias("orderkey"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.when(n > 3, "TRUE").otherwise("false").alias("flag"),
        F.when(n > 3, "true").otherwise(text).alias("flag_or_int"),
        F.when(n > 3, F.concat(text, F.lit(".5"))).otherwise(text).alias("int_or_float"),
        F.concat(F.lit("922337203685477580"), text).alias("around_int64"),
        F.concat(text, F.lit("e3")).alias("sci"),
        F.concat(F.lit(" "), text).alias("spaced"),
        F.concat(text, F.lit("d")).alias("suffixed"),
        F.when(n > 3, "inf").otherwise("NaN").alias("special"),
        F.when(n > 3, "0x1p-2").otherwise("-.5").alias("hexfloat"),
        F.when(n > 3, "1e999").otherwise(text).alias("overflow"),
        F.when(n > 3, "").otherwise(text).alias("sparse"),
        F.lit("").alias("blank"),
        F.lit(None).cast("string").alias("absent"),
        F.col("l_returnflag").alias("word"),
    )


CELLS = """cells AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS orderkey, CAST(l_extendedprice AS VARCHAR) AS price,
         CASE WHEN l_linenumber > 3 THEN 'TRUE' ELSE 'false' END AS flag,
         CASE WHEN l_linenumber > 3 THEN 'true' ELSE l_linenumber::VARCHAR END AS flag_or_int,
         CASE WHEN l_linenumber > 3 THEN l_linenumber || '.5' ELSE l_linenumber::VARCHAR END AS int_or_float,
         '922337203685477580' || l_linenumber AS around_int64, l_linenumber || 'e3' AS sci,
         ' ' || l_linenumber AS spaced, l_linenumber || 'd' AS suffixed,
         CASE WHEN l_linenumber > 3 THEN 'inf' ELSE 'NaN' END AS special,
         CASE WHEN l_linenumber > 3 THEN '0x1p-2' ELSE '-.5' END AS hexfloat,
         CASE WHEN l_linenumber > 3 THEN '1e999' ELSE l_linenumber::VARCHAR END AS overflow,
         CASE WHEN l_linenumber > 3 THEN '' ELSE l_linenumber::VARCHAR END AS sparse,
         '' AS blank, CAST(NULL AS VARCHAR) AS absent, l_returnflag AS word
  FROM lineitem)"""


# ---- JSON records -----------------------------------------------------------------------


def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON texts with fields of every kind, written the same way by both engines."""
    e = ev(spark, sf)
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    record = F.concat(
        F.lit('{"source_key":'), quoted,
        F.lit(',"question_id":"'), F.col("question_id"),
        F.lit('","event_id":'), F.col("event_id").cast("string"),
        F.lit(',"value":'), F.col("value").cast("string"),
        F.lit(',"int_or_float":'), F.when(F.col("k") > 50, "2.5").otherwise("2"),
        F.lit(',"mixed":'), F.when(F.col("k") > 50, quoted).otherwise(F.col("k").cast("string")),
        F.lit(',"flag":'), F.when(F.col("k") > 50, "true").otherwise("false"),
        F.lit(',"flag_or_null":'), F.when(F.col("k") > 50, "true").otherwise("null"),
        F.lit(',"nothing":null,"big":12345678901234567890,"sci":1e3,"items":[1,2],"props":'), F.col("props"),
        F.lit(',"answer":'), F.when(F.col("k") > 50, quoted).otherwise(F.col("props")),
        F.lit("}"),
    )
    return e.select("event_id", record.alias("record"))


JSON_RECORDS = """json_records AS (
  SELECT event_id, '{"source_key":"' || event_type || '","question_id":"' || question_id || '","event_id":' || event_id
      || ',"value":' || CAST(value AS VARCHAR)
      || ',"int_or_float":' || CASE WHEN k > 50 THEN '2.5' ELSE '2' END
      || ',"mixed":' || CASE WHEN k > 50 THEN '"' || event_type || '"' ELSE CAST(k AS VARCHAR) END
      || ',"flag":' || CASE WHEN k > 50 THEN 'true' ELSE 'false' END
      || ',"flag_or_null":' || CASE WHEN k > 50 THEN 'true' ELSE 'null' END
      || ',"nothing":null,"big":12345678901234567890,"sci":1e3,"items":[1,2],"props":' || props
      || ',"answer":' || CASE WHEN k > 50 THEN '"' || event_type || '"' ELSE props END || '}' AS record
  FROM ev)"""


def _quoted(text):
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def encoded_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records with a doubly encoded state; broken in various ways by ``event_id % 7``."""
    e = ev(spark, sf)
    way = F.col("event_id") % 7
    good_inner = F.concat(F.lit('{"answer":"é'), F.col("event_type"), F.lit('","k":'), F.col("k").cast("string"), F.lit("}"))
    inner = F.when(way == 1, F.lit("bad json{")).when(way == 4, F.lit("[1]")).otherwise(good_inner)
    outer = F.when(way == 0, F.lit("not json{")).otherwise(
        F.concat(F.lit('{"interactiveState":'), _quoted(inner), F.lit(',"v":'), F.col("k").cast("string"), F.lit("}"))
    )
    state = (
        F.when(way == 2, F.lit(""))
        .when(way == 3, F.concat(F.lit(',"report_state":{"v":'), F.col("k").cast("string"), F.lit("}")))
        .when(way == 5, F.lit(',"report_state":null'))
        .otherwise(F.concat(F.lit(',"report_state":'), _quoted(outer)))
    )
    record = F.concat(F.lit('{"question_id":"'), F.col("question_id"), F.lit('"'), state, F.lit("}"))
    return e.select("event_id", record.alias("record"))


ENCODED = r"""encoded AS (
  SELECT *, CASE event_id % 7 WHEN 1 THEN 'bad json{' WHEN 4 THEN '[1]'
              ELSE '{"answer":"é' || event_type || '","k":' || k || '}' END AS inner_text FROM ev),
outers AS (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN 'not json{'
              ELSE '{"interactiveState":' || '"' || replace(replace(inner_text, '\', '\\'), '"', '\"') || '"' || ',"v":' || k || '}' END AS outer_text
  FROM encoded),
records AS (
  SELECT event_id, CAST('{"question_id":"' || question_id || '"' || CASE event_id % 7
      WHEN 2 THEN '' WHEN 3 THEN ',"report_state":{"v":' || k || '}' WHEN 5 THEN ',"report_state":null'
      ELSE ',"report_state":' || '"' || replace(replace(outer_text, '\', '\\'), '"', '\"') || '"' END || '}' AS JSON) AS record
  FROM outers),
steps AS (
  SELECT event_id, record->'$.report_state' AS state,
         CASE json_type(record->'$.report_state') WHEN 'VARCHAR' THEN record->>'$.report_state' WHEN 'NULL' THEN '' END AS outer_text
  FROM records),
outer_step AS (
  SELECT *, TRY_CAST(outer_text AS JSON) AS outer_json FROM steps),
inner_step AS (
  SELECT *, CASE WHEN json_type(outer_json->'$.interactiveState') = 'VARCHAR' THEN outer_json->>'$.interactiveState' END AS inner_text
  FROM outer_step),
decoded AS (
  SELECT *, TRY_CAST(inner_text AS JSON) AS inner_json FROM inner_step)"""


# ---- attachments ------------------------------------------------------------------------


def attachment_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answer records that name a shared state file and a private audio file."""
    d = table(spark, sf, "documents")
    doc = F.col("doc_id").cast("string")
    kind = F.element_at(
        F.array(*[F.lit(t) for t in ("application/json", "text/plain", "", "IMAGE/SVG+XML")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    name = F.concat(F.col("lang"), F.lit(" state?.json"))
    attachments = F.concat(
        F.lit('{"'), name, F.lit('":{"publicPath":"p/'), (F.col("doc_id") % 200).cast("string"),
        F.lit('","contentType":"'), kind, F.lit('","folder":{"id":1}},"CON.mp3":{"publicPath":"a/'), doc,
        F.lit('","contentType":"audio/mpeg"}}'),
    )
    state = F.when(
        F.col("n_chars") % 2 == 0,
        F.concat(F.lit('{"a":[{"__attachment__":"'), name, F.lit('"}],"note":"\\"__attachment__\\": \\"CON.mp3\\""}')),
    ).otherwise(F.lit('{"a":[]}'))
    return d.select(
        F.col("source").alias("source_key"), F.concat(F.lit("u"), doc).alias("remote_endpoint"),
        F.concat(F.lit("q"), (F.col("doc_id") % 4).cast("string")).alias("question_id"),
        doc.alias("id"), "doc_id", attachments.alias("attachments"), state.alias("report_state"),
    )


def refs(spark: SparkSession, sf: str) -> DataFrame:
    return attachment_refs(attachment_records(spark, sf), "answers", F.col("doc_id"))


REFS = """refs AS (
  SELECT 'answers' AS collection, source, 'p/' || (doc_id % 200) AS public_path,
         ['application/json', 'text/plain', '', 'IMAGE/SVG+XML'][doc_id % 4 + 1] AS content_type,
         lang || ' state?.json' AS name, CAST(doc_id AS VARCHAR) AS doc_id, n_chars % 2 = 0 AS state,
         source AS source_key, 'u' || doc_id AS remote_endpoint, 'q' || (doc_id % 4) AS question_id, doc_id AS position
  FROM documents
  UNION ALL
  SELECT 'answers', source, 'a/' || doc_id, 'audio/mpeg', 'CON.mp3', CAST(doc_id AS VARCHAR), false,
         source, 'u' || doc_id, 'q' || (doc_id % 4), doc_id
  FROM documents)"""

FILE_NAME = """substr(sha256(source || '|' || public_path), 1, 12) || '_'
    || CASE WHEN name = 'CON.mp3' THEN '_CON.mp3' ELSE regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') END"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Files on disk with their content: state files in two of the languages, plus strays."""
    r = refs(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("position"), "text")
    named = r.join(d, "position").select(
        attachment_file("source", "public_path", F.col("name")).alias("file"), "position",
        F.when(F.col("content_type") == "application/json", F.concat(F.lit('{"v":'), F.length("text").cast("string"), F.lit("}")))
        .otherwise(F.col("text")).alias("content"),
    )
    # The newest writer of a shared file wins.
    return named.groupBy("file").agg(F.max_by("content", "position").alias("content")).withColumn(
        "size", F.octet_length("content").cast("bigint")
    )


FILES = f"""named AS (
  SELECT {FILE_NAME} AS file, position,
         CASE WHEN content_type = 'application/json' THEN '{{"v":' || length(text) || '}}' ELSE text END AS content
  FROM refs JOIN (SELECT doc_id AS position, text FROM documents) USING (position)),
files AS (
  SELECT file, max_by(content, position) AS content, CAST(strlen(max_by(content, position)) AS BIGINT) AS size
  FROM named GROUP BY file)"""

INDEX = f"""firsts AS (
  SELECT *, bool_or(state) OVER (PARTITION BY source, public_path) AS any_state,
         count(*) OVER (PARTITION BY source, public_path) AS n_refs
  FROM refs QUALIFY row_number() OVER (PARTITION BY source, public_path ORDER BY position, name, doc_id) = 1),
idx AS (
  SELECT substr(sha256(source || '|' || public_path), 1, 12) AS id12, name, source, public_path, content_type,
         size, any_state AS state, n_refs, file
  FROM (SELECT *, {FILE_NAME} AS file FROM firsts) JOIN files USING (file))"""


# ---- manifests --------------------------------------------------------------------------


def downloads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as download rows."""
    o = table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    return o.select(
        F.when(F.col("o_orderstatus") == "F", "report").when(F.col("o_orderstatus") == "P", "report_job").otherwise("answers").alias("type"),
        F.col("o_orderkey").alias("run_id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("job_id"),
        priority.alias("slug"),
        F.when(priority == "1-URGENT", "answers").when(priority == "2-HIGH", "usage").when(priority == "5-LOW", "").otherwise("coursework").alias("report_type"),
        (F.col("o_totalprice") >= 50000).alias("complete"),
        (F.col("o_totalprice") > 400000).alias("recovered"),
        (F.col("o_orderkey") % 100).alias("row_count"),
        F.col("o_custkey").alias("custkey"),
    )


DOWNLOADS = """downloads AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'report' WHEN 'P' THEN 'report_job' ELSE 'answers' END AS type,
         o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN o_custkey END AS job_id, o_orderpriority AS slug,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'answers' WHEN '2-HIGH' THEN 'usage' WHEN '5-LOW' THEN '' ELSE 'coursework' END AS report_type,
         o_totalprice >= 50000 AS complete, o_totalprice > 400000 AS recovered, o_orderkey % 100 AS row_count,
         o_custkey AS custkey
  FROM orders)"""


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
