"""Identity, dedup, merge, membership and coverage over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import ANSWER_KEY, HISTORY_KEY, identity_key
from runlake.operators import (
    coverage, covered_set, dedup_runs, dedup_segment, explain_membership, membership_of,
    membership_summary, merge_store, run_view,
)

from . import shapes as S
from .registry import query

POS = ("event_id",)
OUT = (*ANSWER_KEY, "_run_id AS run_id", "event_id", "value")


@query("""
SELECT event_id, strlen(event_type) || ':' || event_type || strlen('u' || user_id) || ':u' || user_id
         || '2:q' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS answer_key,
       strlen(event_type) || ':' || event_type || strlen('u' || user_id) || ':u' || user_id
         || '2:q' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4)
         || strlen(CAST(event_id AS VARCHAR)) || ':' || event_id AS history_key
FROM events""")
def identity_keys(spark, sf):
    """H1."""
    return S.ev(spark, sf).select(
        "event_id", identity_key(*ANSWER_KEY).alias("answer_key"), identity_key(*HISTORY_KEY).alias("history_key")
    )


@query("""
SELECT conv_id, turn, md5(strlen(role) || ':' || role || strlen(text) || ':' || text || '0:') AS key_md5
FROM conversations""")
def identity_keys_text(spark, sf):
    """H1 on whole non-ASCII texts and an absent field."""
    c = S.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(identity_key("role", "text", F.lit(None).cast("string"))).alias("key_md5"))


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM d1""")
def dedup_segment_last(spark, sf):
    """D1."""
    return dedup_segment(S.ev(spark, sf), "answers", POS).selectExpr(*OUT)


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM d2""")
def dedup_runs_latest(spark, sf):
    """D1 then D2."""
    return dedup_runs(dedup_segment(S.ev(spark, sf), "answers", POS), "answers").selectExpr(*OUT)


def _first_merge(spark, sf):
    ev = S.ev(spark, sf)
    return merge_store(None, ev, None, "answers", [500, 501], POS)


def _second_merge(spark, sf):
    """Runs 500 and 501 are in the store; 501 comes again, shrunk, together with 502."""
    first = _first_merge(spark, sf)
    ev = S.ev(spark, sf)
    again = ev.where((F.col("_run_id") == 502) | ((F.col("_run_id") == 501) & (F.col("value") >= S.SHRUNK_FROM)))
    return merge_store(first.store, again, first.membership, "answers", [501, 502], POS)


MERGE = f"""{S.EV},
first_seg AS (SELECT * FROM ev WHERE _run_id IN (500, 501)),
{S.last_per_run('first_d1', 'first_seg')},
{S.newest('old', 'first_d1')},
seg AS (SELECT * FROM ev WHERE _run_id = 502 OR (_run_id = 501 AND value >= {S.SHRUNK_FROM})),
{S.last_per_run('seg_d1', 'seg')},
{S.newest('src', 'seg_d1')},
covered AS (SELECT {S.KEYS} FROM ev WHERE _run_id = 500 UNION SELECT {S.KEYS} FROM seg),
merged AS (
  SELECT {S.KEYS}, coalesce(s._run_id, o._run_id) AS run_id, coalesce(s.event_id, o.event_id) AS event_id,
         coalesce(s.value, o.value) AS value,
         CASE WHEN s.event_id IS NOT NULL AND o.event_id IS NOT NULL THEN 'updated'
              WHEN s.event_id IS NOT NULL THEN 'new'
              WHEN ({S.KEYS}) IN (SELECT ({S.KEYS}) FROM covered) THEN 'kept' ELSE 'removed' END AS status
  FROM src s FULL JOIN old o USING ({S.KEYS}))"""


@query(f"WITH {MERGE} SELECT * FROM merged WHERE status <> 'removed'")
def merge_into_store(spark, sf):
    """C3, C2, I4."""
    return _second_merge(spark, sf).store.selectExpr(*OUT, "_status AS status")


@query(f"WITH {MERGE} SELECT {S.KEYS} FROM merged WHERE status = 'removed'")
def merge_removed(spark, sf):
    """What the merge drops."""
    return _second_merge(spark, sf).removed


@query(f"""
WITH {MERGE}, runs AS (SELECT _run_id AS run_id, count(*) AS fetched FROM seg GROUP BY 1)
SELECT run_id, fetched,
       (SELECT count(*) FROM merged m WHERE m.run_id = r.run_id AND status = 'new') AS new,
       (SELECT count(*) FROM merged m WHERE m.run_id = r.run_id AND status = 'updated') AS updated,
       CASE WHEN run_id = 501 THEN (SELECT count(*) FROM merged WHERE status = 'removed') ELSE 0 END AS removed
FROM runs r""")
def merge_counts_per_run(spark, sf):
    """D3."""
    return _second_merge(spark, sf).counts


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT _run_id AS run_id, (SELECT count(*) FROM ev e WHERE e._run_id = d2._run_id) AS fetched,
       count(*) AS new, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS removed
FROM d2 GROUP BY _run_id""")
def sweep_backlog(spark, sf):
    """Three waiting runs merged in one rewrite."""
    return merge_store(None, S.ev(spark, sf), None, "answers", [500, 501, 502], POS).counts


@query(f"""
WITH {S.EV}, {S.last_per_run('hd1', 'ev', S.KEYS + ', history_id')}, {S.newest('hd2', 'hd1', S.KEYS + ', history_id')}
SELECT {S.KEYS}, history_id, _run_id AS run_id, value FROM hd2""")
def merge_history(spark, sf):
    """C3 on the four-column identity."""
    store = merge_store(None, S.ev(spark, sf), None, "history", [500, 501, 502], POS).store
    return store.select(*HISTORY_KEY, F.col("_run_id").alias("run_id"), "value")


def _all_runs(spark, sf, record_type="answers"):
    merged = merge_store(None, S.ev(spark, sf), None, record_type, [500, 501, 502], POS)
    return merged.store, merged.membership


@query(f"""
WITH {S.EV}, {S.last_per_run('d1', 'ev')}, {S.newest('d2', 'd1')}
SELECT {S.KEYS}, _run_id AS run_id, event_id, value FROM d2
WHERE ({S.KEYS}) IN (SELECT ({S.KEYS}) FROM ev WHERE _run_id = 501)""")
def run_view_answers(spark, sf):
    """C1."""
    store, members = _all_runs(spark, sf)
    return run_view(store, members, "answers", 501).selectExpr(*OUT)


@query(f"""WITH {S.EV} SELECT {S.KEYS}, history_id, value FROM ev WHERE _run_id = 502""")
def run_view_history(spark, sf):
    """C1 for history."""
    store, members = _all_runs(spark, sf, "history")
    return run_view(store, members, "history", 502).select(*HISTORY_KEY, "value")


@query(f"WITH {S.EV} SELECT DISTINCT {S.KEYS}, _run_id AS run_id FROM ev")
def membership_explained(spark, sf):
    """C9, one row per record and covering run."""
    store, members = _all_runs(spark, sf)
    return explain_membership(store, members, "answers")


@query(f"""
WITH {S.EV}
SELECT {S.KEYS}, count(DISTINCT _run_id) AS n_runs, min(_run_id) AS first_run, max(_run_id) AS last_run
FROM ev GROUP BY {S.KEYS}""")
def membership_per_record(spark, sf):
    """C9 per record."""
    store, members = _all_runs(spark, sf)
    return membership_summary(store, members, "answers")


@query(f"""
WITH {S.EV}
SELECT DISTINCT 'answers' AS type, _run_id AS run_id, {S.KEYS}, CAST(NULL AS VARCHAR) AS history_id FROM ev
UNION ALL SELECT 'history', _run_id, {S.KEYS}, history_id FROM ev""")
def run_membership(spark, sf):
    """Memberships of both record types in one table."""
    ev = S.ev(spark, sf)
    return membership_of(ev, "answers").unionByName(membership_of(ev, "history"))


@query(f"""
WITH {S.EV}
SELECT {S.KEYS} FROM ev WHERE _run_id <> 501
UNION SELECT {S.KEYS} FROM ev WHERE _run_id = 501 AND value >= {S.SHRUNK_FROM}""")
def covered_identities(spark, sf):
    """G4."""
    ev = S.ev(spark, sf)
    merging = membership_of(ev.where((F.col("_run_id") == 501) & (F.col("value") >= S.SHRUNK_FROM)), "answers")
    return covered_set(membership_of(ev, "answers"), "answers", merging, [501])


@query(f"""
WITH {S.EV}, asked AS (SELECT CAST(count(*) AS BIGINT) AS n FROM customer),
found AS (SELECT _run_id AS run_id, count(DISTINCT remote_endpoint) AS with_data FROM ev GROUP BY 1)
SELECT 'answers' AS type, run_id, CASE run_id WHEN 500 THEN n WHEN 501 THEN 10 END AS queried, with_data,
       CASE run_id WHEN 500 THEN n WHEN 501 THEN 10 END - with_data AS empty
FROM found, asked""")
def coverage_by_run(spark, sf):
    """A known total, one that is too small, and an unknown one."""
    asked = S.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("n"))
    run = F.explode(F.array(*[F.lit(r).cast("bigint") for r in (500, 501, 502)]))
    queried = asked.select("n", run.alias("run_id")).select(
        F.lit("answers").alias("type"), "run_id",
        F.when(F.col("run_id") == 500, F.col("n")).when(F.col("run_id") == 501, F.lit(10).cast("bigint")).alias("queried"),
    )
    return coverage(membership_of(S.ev(spark, sf), "answers"), queried)
