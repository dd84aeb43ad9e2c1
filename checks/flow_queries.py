"""Streaming ingest, views and export."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from runlake.functions import ANSWER_KEY, rfc3339
from runlake.operators import attachment_index
from runlake.plans import Dataset, DatasetFrames, ReportRun, register_views, sql
from runlake.session import work_dir
from runlake.sources import collect_capped, json_friendly, write_result
from runlake.streaming import merge_landing

from . import shapes as S
from .record_queries import _all_runs
from .registry import query


@query(f"""
WITH {S.EV}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM ev
QUALIFY row_number() OVER (PARTITION BY {S.KEYS} ORDER BY _run_id DESC, event_id % 5 = 4 DESC, event_id DESC) = 1""")
def streamed_merge(spark, sf):
    """All events land as pages in two parts; one stream takes the pages of all runs, one merge follows; late pages win."""
    e = S.ev(spark, sf)
    ds = Dataset.create(spark, work_dir(spark, "dataset"), "fall")
    landed, checkpoint = work_dir(spark, "landing"), work_dir(spark, "checkpoint")
    for late in (False, True):
        part = e.where((F.col("event_id") % 5 == 4) == F.lit(late))
        _land(part, landed, "1")
        merge_landing(ds, "answers", landed, checkpoint, fetched_at=F.timestamp_seconds("run_id"))
    store = ds.frames().stores["answers"]
    return store.select(*ANSWER_KEY, F.col("_run_id").alias("run_id"), "event_id", "value")


def _land(e, landed, fetch):
    """Events as pages of their run's fetch, in event order."""
    record = F.struct(*ANSWER_KEY, "event_id", "value")
    rows = e.repartitionByRange(F.col("_run_id"), F.col("event_id")).sortWithinPartitions("_run_id", "event_id")
    rows = rows.select(F.to_json(record).alias("value"), F.col("_run_id").alias("run_id"), F.lit(fetch).alias("fetch"))
    rows.write.mode("append").partitionBy("run_id", "fetch").text(landed)


@query(f"""
WITH {S.EV}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM ev WHERE _run_id <> 500 OR event_id % 4 < 2
QUALIFY row_number() OVER (PARTITION BY {S.KEYS} ORDER BY _run_id = 500 DESC, _run_id DESC, event_id DESC) = 1""")
def late_pages_of_old_fetch(spark, sf):
    """Run 500 is fetched anew with half of its events; pages of its first fetch that land later change nothing."""
    e = S.ev(spark, sf)
    ds = Dataset.create(spark, work_dir(spark, "dataset"), "fall")
    landed, checkpoint = work_dir(spark, "landing"), work_dir(spark, "checkpoint")
    again = e.where("_run_id = 500")
    for fetch, part in (("1", e.where("_run_id <> 500 or event_id % 4 < 3")), ("2", again.where("event_id % 4 < 2")), ("1", again.where("event_id % 4 = 3"))):
        _land(part, landed, fetch)
        with warnings.catch_warnings():
            warnings.filterwarnings("ignore", "answers run 500: pages of fetch 1, which a newer one replaced")
            merge_landing(ds, "answers", landed, checkpoint, fetched_at=F.timestamp_seconds("run_id"))
    store = ds.frames().stores["answers"]
    return store.select(*ANSWER_KEY, F.col("_run_id").alias("run_id"), "event_id", "value")


def _frames(spark, sf):
    store, members = _all_runs(spark, sf)
    files = S.files(spark, sf)
    return DatasetFrames(
        name="fall", stores={"answers": store}, membership=members,
        member_runs=[("answers", 500), ("answers", 501), ("answers", 502)], downloads=S.downloads(spark, sf),
        reports=[
            ReportRun(1, "answers", S.report_run_1(spark, sf)), ReportRun(2, "usage", S.report_run_2(spark, sf)),
            ReportRun(3, "coursework", S.report_run_3(spark, sf)),
        ],
        attachments=attachment_index(S.refs(spark, sf), files), texts=files,
    )


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT m.run_id, d2.question_id, count(*) AS answered, round(sum(d2.value), 2) AS total
FROM d2 JOIN (SELECT DISTINCT _run_id AS run_id, {S.KEYS} FROM ev) m USING ({S.KEYS}) GROUP BY ALL""")
def sql_over_views(spark, sf):
    """K1, K2: user SQL joining answers to run_membership."""
    register_views(spark, [(None, _frames(spark, sf))])
    return sql(spark, """
        SELECT m.run_id, a.question_id, count(*) AS answered, round(sum(a.value), 2) AS total
        FROM answers a JOIN run_membership m USING (source_key, remote_endpoint, question_id)
        WHERE m.type = 'answers' GROUP BY m.run_id, a.question_id""")


@query(f"""
WITH {S.EV}, {S.RUN_1}
SELECT 'reports' AS part, (SELECT count(*) FROM run1 WHERE student_id NOT IN ('Prompt', 'Correct answer')) + (SELECT count(*) FROM supplier) AS n
UNION ALL SELECT 'report_3', count(*) FROM part
UNION ALL SELECT 'answers_501', count(*) FROM (SELECT DISTINCT {S.KEYS} FROM ev WHERE _run_id = 501)
UNION ALL SELECT 'downloads', count(*) FROM orders
UNION ALL SELECT 'history', CAST(0 AS BIGINT)""")
def sql_over_two_datasets(spark, sf):
    """K1 for several datasets: prefixed views, per-run views, an absent store."""
    frames = _frames(spark, sf)
    register_views(spark, [(None, frames), ("spring", frames)])
    return sql(spark, """
        SELECT 'reports' AS part, count(*) AS n FROM fall__reports
        UNION ALL SELECT 'report_3', count(*) FROM spring__report_3
        UNION ALL SELECT 'answers_501', count(*) FROM fall__answers_501
        UNION ALL SELECT 'downloads', count(*) FROM spring__downloads
        UNION ALL SELECT 'history', count(*) FROM spring__history""")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority FROM orders""")
def export_roundtrip(spark, sf):
    """Orders written as CSV and as JSON lines; the rows both copies hold."""
    orders = S.table(spark, sf, "orders")
    out = work_dir(spark, "export")
    write_result(orders, f"{out}/csv", "csv")
    write_result(orders, f"{out}/jsonl", "jsonl")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    from_csv = spark.read.schema(schema).csv(f"{out}/csv", header=True)
    from_json = spark.read.schema(schema).json(f"{out}/jsonl")
    # Both sides are compared as whole rows: only rows equal in both copies remain.
    return from_csv.join(from_json, from_csv.columns, "left_semi")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || rtrim(strftime(ts, '%f'), '0') || 'Z' AS ts,
  CASE WHEN event_id % 5 = 0 THEN '"NaN"' WHEN event_id % 5 = 1 THEN '"+Inf"' WHEN event_id % 5 = 2 THEN '"-Inf"' ELSE CAST(value AS VARCHAR) END AS value
FROM events""")
def json_friendly_values(spark, sf):
    """Instants and non-finite numbers."""
    e = S.table(spark, sf, "events")
    way = F.col("event_id") % 5
    value = F.when(way == 0, float("nan")).when(way == 1, float("inf")).when(way == 2, float("-inf")).otherwise(F.col("value"))
    shown = json_friendly(e.select("event_id", "ts", value.alias("value")))
    return shown.select("event_id", "ts", F.to_json("value").alias("value"))


@query("""SELECT count(*) > 1000 AS truncated, count(*) AS row_count, least(count(*), 1000) AS shown, 6 AS n_columns FROM orders""")
def capped_result(spark, sf):
    """The cap is the feature; the count is of all rows."""
    columns, rows, truncated, total = collect_capped(S.table(spark, sf, "orders"))
    return spark.createDataFrame([(truncated, total, len(rows), len(columns))], "truncated boolean, row_count bigint, shown bigint, n_columns int")
