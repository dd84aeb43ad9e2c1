"""Files and datasets at rest: written to the working folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import ANSWER_KEY
from runlake.operators import describe_csv, membership_of, recover_report_type, union_runs
from runlake.plans import Dataset, list_datasets, register_views, sql
from runlake.session import work_dir
from runlake.sources import (
    append_records, failed_casts, list_files, read_cells, read_chosen_texts, read_membership, read_record_lines, read_segments, read_store,
    read_text_files, scan_report_csv, text_chunks, write_membership, write_store,
)

from . import shapes as S
from .record_queries import OUT, _all_runs
from .registry import query


@query(f"""
WITH {S.RUN_1}
SELECT CAST(1 AS BIGINT) AS run_id, student_id, TRY_CAST(res_1_q1_answer AS DOUBLE) AS amount, res_1_q2_answer
FROM run1 WHERE student_id NOT IN ('Prompt', 'Correct answer')""")
def csv_scanned(spark, sf):
    """A1, A2: a report written as CSV, described, scanned by position."""
    path = work_dir(spark, "csv")
    S.report_run_1(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    found = describe_csv(read_cells(spark, path), "answers").head()["columns"]
    columns = {c["column"]: c["type"] for c in found}
    rows = scan_report_csv(spark, path, columns, [c["column"] for c in found], 1)
    rows = union_runs({1: (rows.drop("run_id"), "answers")})
    return rows.select("run_id", "student_id", F.col("res_1_q1_answer").try_cast("double").alias("amount"), "res_1_q2_answer")


@query("""
SELECT 'amount' AS "column", 'BIGINT' AS type, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS failed FROM orders
UNION ALL SELECT 'open', 'BOOLEAN', count(*) FILTER (WHERE o_orderkey % 5 = 0) FROM orders""")
def failed_casts_counted(spark, sf):
    """A1: cells that the recorded types cannot hold, per column; empty cells and good columns do not count."""
    path, key = work_dir(spark, "csv"), F.col("o_orderkey")
    S.table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 7 == 0, "n/a").when(key % 7 == 1, "").otherwise(F.col("o_custkey").cast("string")).alias("amount"),
        F.when(key % 5 == 0, "perhaps").otherwise("true").alias("open"), "o_orderpriority",
    ).write.option("header", True).option("escape", '"').csv(path)
    columns = {"o_orderkey": "BIGINT", "amount": "BIGINT", "open": "BOOLEAN", "o_orderpriority": "VARCHAR"}
    return failed_casts(spark, path, columns, list(columns))


@query("""
SELECT CAST(4 AS BIGINT) AS run_id, doc_id, md5(text) AS text_md5, lang FROM documents""")
def csv_with_line_breaks(spark, sf):
    """A1: whole texts with line breaks and quotes survive as cells."""
    path = work_dir(spark, "csv")
    d = S.table(spark, sf, "documents").select("doc_id", "text", "lang")
    d.write.option("header", True).option("escape", '"').csv(path)
    rows = scan_report_csv(spark, path, {"doc_id": "BIGINT", "text": "VARCHAR", "lang": "VARCHAR"}, ["doc_id", "text", "lang"], 4)
    return rows.select("run_id", "doc_id", F.md5("text").alias("text_md5"), "lang")


@query(f"""
WITH {S.EV}
SELECT DISTINCT 'answers' AS type, _run_id AS run_id, {S.KEYS}, CAST(NULL AS VARCHAR) AS history_id FROM ev
UNION ALL SELECT 'history', _run_id, {S.KEYS}, history_id FROM ev""")
def membership_files(spark, sf):
    """A6, A5."""
    path = work_dir(spark, "membership")
    ev = S.ev(spark, sf)
    write_membership(membership_of(ev, "answers").unionByName(membership_of(ev, "history")), path)
    return read_membership(spark, path)


@query("""
SELECT event_id, CAST(500 + event_id % 3 AS BIGINT) AS run_id, CAST(1700000000 + event_id % 3 AS BIGINT) AS fetched
FROM events""")
def segments_appended(spark, sf):
    """Three runs' records stamped and appended, one of them delivered twice."""
    path = work_dir(spark, "segments")
    e = S.table(spark, sf, "events").select("event_id", "event_type", F.col("event_id").alias("_position"))
    for run, batch in ((0, "1"), (1, "7"), (2, "1"), (2, "1")):
        at = F.timestamp_millis(F.lit(1_700_000_000_900 + run * 1000))
        append_records(e.where(F.col("event_id") % 3 == run), path, at, 500 + run, batch)
    return read_segments(spark, path, [500, 501, 502]).select(
        "event_id", F.col("_run_id").alias("run_id"), F.unix_seconds("_fetched_at").alias("fetched")
    )


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM d2""")
def store_written(spark, sf):
    """A store version in identity order."""
    path = work_dir(spark, "store")
    write_store(_all_runs(spark, sf)[0], path, "answers")
    return read_store(spark, path).selectExpr(*OUT)


@query("""SELECT doc_id // 50 AS part, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY ALL""")
def text_files_read(spark, sf):
    """Documents written as text files of at most 50, read back as whole files."""
    path = work_dir(spark, "texts")
    part = F.floor(F.col("doc_id") / 50).alias("part")
    S.table(spark, sf, "documents").select("text", part).repartition("part").write.partitionBy("part").text(path)
    content = read_text_files(spark, path + "/*").select("path", F.length("content").alias("n"))
    return content.groupBy(F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint").alias("part")).agg(F.sum("n").alias("chars"))


@query("""
SELECT doc_id // 50 AS part, sum(length(text) + 1)::BIGINT AS chars, CAST(ceil(sum(strlen(text) + 1) / 4096) AS BIGINT) AS chunks FROM documents GROUP BY ALL""")
def chosen_texts_read(spark, sf):
    """Documents as text files beside others, chosen by name before any is opened; the same as chunk rows of 4096 bytes."""
    path = work_dir(spark, "texts")
    part = F.floor(F.col("doc_id") / 50).alias("part")
    S.table(spark, sf, "documents").select("text", part).repartition("part").write.partitionBy("part").text(path + "/documents")
    S.table(spark, sf, "pages").select("html").write.text(path + "/pages")
    files = list_files(spark, path).where(F.col("path").contains("/documents/part="))
    number = F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint").alias("part")
    chars = read_chosen_texts(files).groupBy(number).agg(F.sum(F.length("content")).alias("chars"))
    chunks = text_chunks(files, 4096).groupBy(number).agg(F.sum(F.length("content")).alias("in_chunks"), F.count("*").alias("chunks"))
    return chars.join(chunks, "part").where("chars = in_chunks").select("part", "chars", "chunks")


@query("""
SELECT 'customers' AS report, 'answers' AS report_type, false AS recovered, count(*) AS row_count FROM customer
UNION ALL SELECT 'suppliers', 'recovered', true, count(*) FROM supplier
UNION ALL SELECT 'events', 'log', false, count(*) FROM events""")
def recovered_report_files(spark, sf):
    """CSV files without provenance, their types and row counts from what they hold."""
    frames = {"customers": S.report_run_1(spark, sf), "suppliers": S.report_run_2(spark, sf), "events": S.table(spark, sf, "events")}
    found = []
    for name, df in frames.items():
        path, report = work_dir(spark, "csv"), F.lit(name).alias("report")
        df.write.option("header", True).option("escape", '"').csv(path)
        cells = read_cells(spark, path)
        kind = recover_report_type(cells).select(report, "*")
        # Only an answers report has rows that are no data; the count is of the rows of whatever type is found.
        counts = [describe_csv(cells, t).select(report, F.lit(t).alias("report_type"), "row_count") for t in ("answers", "recovered", "log")]
        found.append(kind.join(S.union_all(counts), ["report", "report_type"]))
    return S.union_all(found)


def _dataset(spark, sf) -> Dataset:
    """Runs 500 and 501 merged in one sweep, then 501 again, shrunk, with 502."""
    e = S.ev(spark, sf)
    state = F.concat(F.lit('{"interactiveState":"{\\"k\\":'), F.col("k").cast("string"), F.lit('}"}'))
    record = F.struct(*ANSWER_KEY, "event_id", "value", state.alias("report_state"), "_run_id")
    ds = Dataset.create(spark, work_dir(spark, "dataset"), "fall")
    for step, (runs, part) in enumerate(
        (([500, 501], e), ([501, 502], e.where(f"_run_id = 502 or value >= {S.SHRUNK_FROM}"))), 1
    ):
        for run in runs:
            landed = work_dir(spark, "landing")
            one = part.where(F.col("_run_id") == run).repartitionByRange(F.col("event_id")).sortWithinPartitions("event_id")
            one.select(F.to_json(record).alias("value")).write.text(landed)
            ds.add_page("answers", run, read_record_lines(spark, landed), str(step), "1", F.timestamp_seconds(F.lit(run)))
            ds.finish_fetch("answers", run, str(step))
        ds.merge("answers", runs[0])
    return ds


FLOW = f"""{S.EV},
old AS (SELECT * FROM ev WHERE _run_id IN (500, 501)
  QUALIFY row_number() OVER (PARTITION BY {S.KEYS} ORDER BY _run_id DESC, event_id DESC) = 1),
seg AS (SELECT * FROM ev WHERE _run_id = 502 OR (_run_id = 501 AND value >= {S.SHRUNK_FROM})),
src AS (SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY {S.KEYS} ORDER BY _run_id DESC, event_id DESC) = 1),
covered AS (SELECT {S.KEYS} FROM ev WHERE _run_id = 500 UNION SELECT {S.KEYS} FROM seg),
flow AS (
  SELECT {S.KEYS}, coalesce(s._run_id, o._run_id) AS run_id, coalesce(s.event_id, o.event_id) AS event_id,
         coalesce(s.value, o.value) AS value, coalesce(s.k, o.k) AS k
  FROM src s FULL JOIN old o USING ({S.KEYS})
  WHERE s.event_id IS NOT NULL OR ({S.KEYS}) IN (SELECT ({S.KEYS}) FROM covered))"""


@query(f"WITH {FLOW} SELECT * FROM flow")
def dataset_at_rest(spark, sf):
    """The whole path on files: pages, decoding, merges, typed store, views, SQL."""
    register_views(spark, [(None, _dataset(spark, sf).frames())])
    return sql(spark, """
        SELECT source_key, remote_endpoint, question_id, _run_id AS run_id, event_id, value,
               CAST(get_json_object(report_state, '$.interactiveState.k') AS bigint) AS k FROM answers""")


@query(f"""
WITH {FLOW}
SELECT 'store' AS kind, CAST(NULL AS BIGINT) AS run_id, CAST(2 AS BIGINT) AS version, count(*) AS n FROM flow
UNION ALL SELECT 'membership', _run_id, CASE WHEN _run_id = 500 THEN 1 ELSE 2 END, count(*) FROM (
  SELECT DISTINCT _run_id, {S.KEYS} FROM ev WHERE _run_id IN (500, 502) OR value >= {S.SHRUNK_FROM}) GROUP BY _run_id""")
def dataset_reindexed(spark, sf):
    """Versions and counts found again from the files alone."""
    ds = _dataset(spark, sf)
    ds.reindex()
    rows = ds.manifest().where("kind in ('store', 'membership')")
    sizes = ds.frames().membership.groupBy("run_id").count().withColumnRenamed("count", "ids")
    return rows.join(sizes, "run_id", "left").select("kind", "run_id", "version", F.coalesce("ids", "count").alias("n"))


def _landed(ds, spark, sf, run, fetch, part):
    """A run's events, landed and waiting for a merge."""
    path = work_dir(spark, "landing")
    record = F.struct(*ANSWER_KEY, "event_id", "value")
    one = part.where(F.col("_run_id") == run).repartitionByRange(F.col("event_id")).sortWithinPartitions("event_id")
    one.select(F.to_json(record).alias("value")).write.text(path)
    ds.add_page("answers", run, read_record_lines(spark, path), fetch, "1", F.timestamp_seconds(F.lit(run)))
    ds.finish_fetch("answers", run, fetch)


class _Overtaken(Dataset):
    """A writer before whose first commit another one commits."""

    other = None

    def _commit(self, entries, commit):
        other, self.other = self.other, None
        if other:
            other()
        super()._commit(entries, commit)


@query(f"""
WITH {S.EV}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM ev
QUALIFY row_number() OVER (PARTITION BY {S.KEYS} ORDER BY _run_id = 500 DESC, _run_id = 501 DESC, event_id DESC) = 1""")
def concurrent_merges(spark, sf):
    """Two writers merge from one commit; the loser merges again, on top of the winner."""
    e = S.ev(spark, sf)
    ds = Dataset.create(spark, work_dir(spark, "dataset"), "fall")
    _landed(ds, spark, sf, 502, "1", e)
    ds.merge("answers", 502)
    for run in (500, 501):
        _landed(ds, spark, sf, run, "1", e)
    loser = _Overtaken(spark, ds.root)
    loser.other = lambda: ds.merge("answers", 501, sweep=False)
    loser.merge("answers", 500, sweep=False)
    return ds.frames().stores["answers"].select(*ANSWER_KEY, F.col("_run_id").alias("run_id"), "event_id", "value")


@query(f"""
WITH {S.EV}
SELECT 'store' AS kind, CAST(NULL AS BIGINT) AS run_id, count(DISTINCT ({S.KEYS})) AS n FROM ev WHERE _run_id <> 500
UNION ALL SELECT 'membership', 500, 0
UNION ALL SELECT 'membership', _run_id, count(DISTINCT ({S.KEYS})) FROM ev WHERE _run_id <> 500 GROUP BY _run_id""")
def reindex_after_empty_refresh(spark, sf):
    """A run refreshed to nothing stays empty when the manifest is rebuilt."""
    e = S.ev(spark, sf)
    ds = Dataset.create(spark, work_dir(spark, "dataset"), "fall")
    for run, fetch, part in ((500, "1", e), (501, "1", e), (502, "1", e), (500, "2", e.where(F.lit(False)))):
        _landed(ds, spark, sf, run, fetch, part)
        ds.merge("answers", run)
    ds.reindex()
    return ds.manifest().where("kind in ('store', 'membership')").select("kind", "run_id", F.col("count").alias("n"))


@query(f"""
WITH {FLOW}
SELECT 'before' AS phase, 'stores' AS what, CAST(1 AS BIGINT) AS orphans, count(*) AS records FROM flow
UNION ALL SELECT 'before', 'membership', 1, count(*) FROM flow
UNION ALL SELECT 'after', 'none', 0, count(*) FROM flow""")
def drift_at_rest(spark, sf):
    """G5 and the vacuum: superseded folders are orphans, then gone, and the store stays as it is."""
    ds = _dataset(spark, sf)
    found = {}
    for phase in ("before", "after"):
        orphans = ds.drift().where("code = 'ORPHAN_FILE'").groupBy(F.substring_index("subject", "/", 1).alias("what")).count().collect()
        found[phase] = [(r["what"], r["count"]) for r in orphans] or [("none", 0)]
        if phase == "before":
            ds.vacuum()
    one = spark.createDataFrame([(p, w, n) for p, rows in found.items() for w, n in rows], "phase string, what string, orphans bigint")
    return one.withColumn("records", F.lit(ds.frames().stores["answers"].count()).cast("bigint"))


@query(f"""
WITH {S.EV}
SELECT CASE _run_id WHEN 500 THEN 'fall' WHEN 501 THEN 'spring' ELSE 'summer' END AS name, count(DISTINCT ({S.KEYS})) AS answers, CAST(0 AS BIGINT) AS history,
  CAST(0 AS BIGINT) AS report, CAST(0 AS BIGINT) AS attachments, true AS has_files FROM ev GROUP BY _run_id""")
def datasets_listed_at_rest(spark, sf):
    """D7 over several datasets at rest."""
    e, roots = S.ev(spark, sf), []
    for name, run in (("fall", 500), ("spring", 501), ("summer", 502)):
        ds = Dataset.create(spark, work_dir(spark, "dataset"), name)
        _landed(ds, spark, sf, run, "1", e)
        ds.merge("answers", run)
        roots.append(ds.root)
    listed = list_datasets(spark, roots)
    return listed.select("name", "answers", "history", "report", "attachments", (F.col("size_bytes") > 0).alias("has_files"))
