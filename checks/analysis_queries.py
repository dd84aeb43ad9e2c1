"""Questions asked of answers, logs and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import ANSWER_KEY, epoch_millis_to_ts, epoch_seconds_to_ts, json_get, json_items
from runlake.operators import (
    answer_distribution, answer_totals, attention, compare_datasets, dedup_runs, dedup_segment, distinct_learners,
    engagement_by_group, event_flags_per_user, join_external, last_n_snapshots, navigation_trace,
    navigation_transitions, responses_per_question, revision_counts, snapshot_diff, time_on_task,
    time_on_task_by_session, union_datasets,
)

from . import shapes as S
from .record_queries import MERGE, POS, _second_merge
from .registry import query


@query(f"""
WITH {MERGE} SELECT question_id, count(*) AS answered FROM merged WHERE status <> 'removed' GROUP BY question_id""")
def responses_after_merge(spark, sf):
    """D8 on the store after two merges: the path from raw fetches to an answer."""
    return responses_per_question(_second_merge(spark, sf).store)


@query(f"""
WITH {S.EV}, t AS (SELECT question_id, CASE WHEN k < 10 THEN '' WHEN k < 15 THEN NULL WHEN k < 20 THEN 'x' || k ELSE CAST(k AS VARCHAR) END AS answer FROM ev)
SELECT question_id, nullif(answer, '') AS answer, count(*) AS n, TRY_CAST(nullif(answer, '') AS DOUBLE) AS numeric FROM t GROUP BY ALL""")
def answer_value_counts(spark, sf):
    """D10."""
    return answer_distribution(_answers(spark, sf), "answer")


@query(f"""
WITH {S.EV}, t AS (SELECT question_id, CASE WHEN k < 10 THEN '' WHEN k < 15 THEN NULL WHEN k < 20 THEN 'x' || k ELSE CAST(k AS VARCHAR) END AS answer FROM ev)
SELECT question_id, count(nullif(answer, '')) AS answered, count(*) - count(nullif(answer, '')) AS blank,
       sum(TRY_CAST(nullif(answer, '') AS DOUBLE)) AS total FROM t GROUP BY question_id""")
def answer_sums(spark, sf):
    """Answered, blank, numeric sum."""
    return answer_totals(_answers(spark, sf), "answer")


def _answers(spark, sf):
    k = F.col("k")
    text = F.when(k < 10, "").when(k < 15, F.lit(None)).when(k < 20, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    return S.ev(spark, sf).select("question_id", text.alias("answer"))


@query(f"""
WITH {S.EV}
SELECT question_id, count(DISTINCT user_id) AS learners FROM ev GROUP BY question_id""")
def learners_per_question(spark, sf):
    """D13."""
    return distinct_learners(S.ev(spark, sf), by=["question_id"])


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
FROM events GROUP BY user_id""")
def event_flags(spark, sf):
    """D9."""
    return event_flags_per_user(S.log(spark, sf), {"errors": "error", "purchases": "purchase"})


@query(f"""
WITH {S.GAPS}
SELECT user_id, count(*) FILTER (WHERE new_session) AS sessions,
       CAST(sum(CASE WHEN new_session THEN 0 ELSE gap_micros END) AS BIGINT) AS active_micros
FROM sessions GROUP BY user_id""")
def time_on_task_gaps(spark, sf):
    """E2 with sessions cut at gaps."""
    return time_on_task(S.log(spark, sf))


@query("""
SELECT user_id, count(*) AS sessions, CAST(sum(span) AS BIGINT) AS active_micros FROM (
  SELECT user_id, CAST(ts AS DATE) AS session, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events GROUP BY ALL)
GROUP BY user_id""")
def time_on_task_sessions(spark, sf):
    """E2 with a session column, here the day."""
    return time_on_task_by_session(S.log(spark, sf).withColumn("session", F.to_date("ts")))


@query(f"""
WITH {S.GAPS}
SELECT prev_event AS from_event, event AS to_event, count(*) AS n FROM sessions WHERE NOT new_session GROUP BY ALL""")
def navigation_moves(spark, sf):
    """Transitions within sessions."""
    return navigation_transitions(S.log(spark, sf))


@query(f"""
WITH {S.GAPS}, numbered AS (
  SELECT *, CAST(sum(CAST(new_session AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM sessions)
SELECT event_id, user_id, event, prev_event, session_no,
       row_number() OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id) AS step FROM numbered""")
def navigation_steps(spark, sf):
    """Ordered trace."""
    return navigation_trace(S.log(spark, sf)).select("event_id", "user_id", "event", "prev_event", "session_no", "step")


@query("""
WITH gaps AS (
  SELECT event_id, user_id, event_type AS event, lag(user_id) OVER w AS prev_event, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap_micros
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
numbered AS (
  SELECT *, coalesce(gap_micros > 1800000000, true) AS new_session FROM gaps),
sessions AS (
  SELECT n.*, CAST(sum(CAST(new_session AS INTEGER)) OVER (PARTITION BY event ORDER BY ts, n.event_id) AS BIGINT) AS session_no, ts
  FROM numbered n JOIN events e USING (event_id))
SELECT event_id, event, prev_event, gap_micros, session_no,
       row_number() OVER (PARTITION BY event, session_no ORDER BY ts, event_id) AS step FROM sessions""")
def steps_of_dense_keys(spark, sf):
    """E3 with few keys, each with a large share of all rows in one bucket of time: cut by density."""
    log = S.log(spark, sf).select("event_id", "event", "user_id", "ts")
    rows = navigation_trace(log, user=["event"], event="user_id", bucket_seconds=1_000_000_000, most_rows=500)
    return rows.select("event_id", "event", "prev_event", "gap_micros", "session_no", "step")


@query(f"""
WITH {S.GAPS}, nexts AS (
  SELECT event, CASE WHEN lead(new_session) OVER w THEN 0 ELSE coalesce(lead(gap_micros) OVER w, 0) END AS focus
  FROM sessions WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event AS target, count(*) AS events, CAST(sum(focus) AS BIGINT) AS focus_micros FROM nexts GROUP BY event""")
def attention_per_target(spark, sf):
    """E6."""
    return attention(S.log(spark, sf))


@query("""
SELECT n_name, c_mktsegment, count(*) AS learners, CAST(sum(events) AS BIGINT) AS events, CAST(sum(purchases) AS BIGINT) AS purchases
FROM (SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id)
JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def engagement_per_class(spark, sf):
    """Events per school (nation) and class (segment) of the roster."""
    one = F.lit(1).cast("bigint")
    totals = {"events": one, "purchases": F.when(F.col("event") == "purchase", one).otherwise(0)}
    return engagement_by_group(S.log(spark, sf), _roster(spark, sf), "user_id", ["n_name", "c_mktsegment"], totals)


def _roster(spark, sf):
    c, n = S.table(spark, sf, "customer"), S.table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment", "n_name")


@query("""
SELECT event_id, user_id, c_name, n_name FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def roster_joined(spark, sf):
    """C8."""
    rows = join_external(S.log(spark, sf), _roster(spark, sf), ["user_id"])
    return rows.select("event_id", "user_id", "c_name", "n_name")


@query(f"""
WITH {S.EV}
SELECT {S.KEYS}, event_id, row_number() OVER (PARTITION BY {S.KEYS} ORDER BY ts_us DESC, event_id DESC) AS rn
FROM (SELECT *, epoch_us(_fetched_at) AS ts_us FROM ev) QUALIFY rn <= 3""")
def newest_snapshots(spark, sf):
    """E1."""
    return last_n_snapshots(S.ev(spark, sf), 3, ["_fetched_at", "event_id"]).select(
        *ANSWER_KEY, "event_id", F.col("rn").cast("bigint").alias("rn")
    )


STATE_SQL = """'{"k":' || k || ',"f' || (k % 5) || '":' || CAST(value AS VARCHAR) || ',"t":"' || (k % 2) || '"}'"""


@query(f"""
WITH {S.EV}, states AS (SELECT *, CAST({STATE_SQL} AS JSON) AS state FROM ev),
pairs AS (SELECT *, lag(state) OVER (PARTITION BY {S.KEYS} ORDER BY _fetched_at, event_id) AS before FROM states),
sets AS (SELECT event_id, state, before, json_keys(state) AS now_keys, coalesce(json_keys(before), CAST([] AS VARCHAR[])) AS then_keys FROM pairs)
SELECT event_id,
  array_to_string(list_sort(list_filter(now_keys, lambda x: NOT list_contains(then_keys, x))), ',') AS added,
  array_to_string(list_sort(list_filter(then_keys, lambda x: NOT list_contains(now_keys, x))), ',') AS dropped,
  array_to_string(list_sort(list_filter(now_keys, lambda x: list_contains(then_keys, x)
     AND json_extract_string(state, '$.' || x) IS DISTINCT FROM json_extract_string(before, '$.' || x))), ',') AS changed
FROM sets""")
def snapshot_changes(spark, sf):
    """E4."""
    k = F.col("k")
    state = F.concat(
        F.lit('{"k":'), k.cast("string"), F.lit(',"f'), (k % 5).cast("string"), F.lit('":'),
        F.col("value").cast("string"), F.lit(',"t":"'), (k % 2).cast("string"), F.lit('"}'),
    )
    rows = snapshot_diff(S.ev(spark, sf).withColumn("state", state), "state", "_fetched_at", "event_id")
    return rows.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("added", "dropped", "changed")])


@query(f"""
WITH {S.EV} SELECT {S.KEYS}, count(*) AS snapshots, count(*) > 1 AS revised FROM ev GROUP BY {S.KEYS}""")
def revisions(spark, sf):
    """E5."""
    return revision_counts(S.ev(spark, sf))


@query("""
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS from_seconds, epoch_us(ts) // 1000 AS from_millis,
       json_extract_string(props, '$.k') AS k FROM events""")
def epoch_columns(spark, sf):
    """H9, H7: both time columns of a log name the same instant."""
    log = S.log(spark, sf)
    return log.select(
        "event_id", F.unix_seconds(epoch_seconds_to_ts(F.col("time"))).alias("from_seconds"),
        F.unix_millis(epoch_millis_to_ts(F.col("timestamp"))).alias("from_millis"), json_get(F.col("extras"), "$.k").alias("k"),
    )


@query("""
WITH j AS (SELECT conv_id, turn, to_json([to_json(text), to_json(turn), to_json(struct_pack(r := role))]) AS doc FROM conversations)
SELECT conv_id, turn, count(*) AS n, md5(string_agg(CASE WHEN i = 2 THEN json_extract_string(item, '$.r') ELSE item->>'$' END, '|' ORDER BY i)) AS items
FROM (SELECT conv_id, turn, unnest(from_json(doc, '["json"]')) AS item, unnest(range(3)) AS i FROM j) GROUP BY ALL""")
def json_array_items(spark, sf):
    """H8: items of a JSON array, H7 within them."""
    c = S.table(spark, sf, "conversations")
    quoted = F.to_json(F.col("text").cast("variant"))
    doc = F.concat(F.lit("["), quoted, F.lit(","), F.col("turn").cast("string"), F.lit(","), F.to_json(F.struct(F.col("role").alias("r"))), F.lit("]"))
    items = c.select("conv_id", "turn", F.posexplode(json_items(doc)).alias("i", "item"))
    text = F.when(F.col("i") == 2, json_get(F.col("item"), "$.r")).otherwise(json_get(F.col("item"), "$"))
    # Three items per document: the group is bounded by the shape, not by the data.
    return items.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n"),
        F.md5(F.concat_ws("|", *[F.max(F.when(F.col("i") == i, text)) for i in range(3)])).alias("items"),
    )


PULLS = f"""{S.EV},
{S.last_per_run('a1', '(SELECT * FROM ev WHERE _run_id IN (500, 501))')}, {S.newest('a', 'a1')},
{S.last_per_run('b1', '(SELECT * FROM ev WHERE _run_id IN (501, 502))')}, {S.newest('b', 'b1')}"""


def _pulls(spark, sf):
    ev = S.ev(spark, sf)

    def pull(*runs):
        return dedup_runs(dedup_segment(ev.where(F.col("_run_id").isin(*runs)), "answers", POS), "answers")

    return pull(500, 501), pull(501, 502)


@query(f"""
WITH {PULLS}
SELECT {S.KEYS}, a.event_id AS a_event, b.event_id AS b_event,
  CASE WHEN b.event_id IS NULL THEN 'only_a' WHEN a.event_id IS NULL THEN 'only_b'
       WHEN a.event_id = b.event_id AND a.value = b.value THEN 'same' ELSE 'changed' END AS status
FROM a FULL JOIN b USING ({S.KEYS})""")
def compared_pulls(spark, sf):
    """G7."""
    a, b = _pulls(spark, sf)
    rows = compare_datasets(a, b, ANSWER_KEY, ["event_id", "value"])
    return rows.select(*ANSWER_KEY, F.col("a.event_id").alias("a_event"), F.col("b.event_id").alias("b_event"), "status")


@query(f"""
WITH {PULLS}
SELECT 'fall' AS dataset, {S.KEYS}, CAST(event_id AS VARCHAR) AS mark, value FROM a
UNION ALL BY NAME SELECT 'spring' AS dataset, {S.KEYS}, event_type AS mark, k FROM b""")
def united_pulls(spark, sf):
    """Pulls of differing columns, a shared column of differing type."""
    a, b = _pulls(spark, sf)
    return union_datasets({
        "fall": a.select(*ANSWER_KEY, F.col("event_id").alias("mark"), "value"),
        "spring": b.select(*ANSWER_KEY, F.col("event_type").alias("mark"), "k"),
    })
