"""Bucketed order-dependent columns against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlake.operators import ordered
from runlake.operators import (
    answer_distribution, answer_totals, attention, compare_datasets, correct_counts, distinct_learners, event_flags_per_user,
    last_n_snapshots, navigation_trace, navigation_transitions, ordered_columns, position_bucket, responses_per_question,
    revision_counts, snapshot_diff, time_on_task, time_on_task_by_session, union_by_name, union_datasets,
)

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def log_rows():
    rng = random.Random(7)
    rows = []
    for i in range(400):
        user = 1 if rng.random() < 0.6 else rng.choice([2, 3, None])
        at = START + timedelta(minutes=rng.choice([0, 0, 5, 29, 30, 31, 600, 3000]) + rng.randrange(5000))
        rows.append((i, user, rng.choice(["open", "page", "drag"]), at))
    return rows


@pytest.fixture(scope="module")
def log(spark, log_rows):
    return spark.createDataFrame(log_rows, "event_id bigint, user_id bigint, event string, ts timestamp").repartition(4).cache()


def sessions_of(rows, gap=1800):
    by_user = {}
    for i, user, event, at in sorted(rows, key=lambda r: (r[3], r[0])):
        sessions = by_user.setdefault(user, [])
        if not sessions or (at - sessions[-1][-1][1]).total_seconds() > gap:
            sessions.append([])
        sessions[-1].append((event, at, i))
    return by_user


def test_ordered_columns_equal_plain_windows(spark, log):
    df = log.withColumn("v", F.col("event_id") % 7)
    order = ["ts", "event_id"]
    for minutes in (1, 60, 100_000):
        bucket = F.floor(F.unix_seconds("ts") / (60 * minutes)).cast("bigint")
        got = ordered_columns(df, ["user_id"], order, bucket, lag={"p": "event"}, sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") > 2, F.col("v"))})
        w = Window.partitionBy("user_id").orderBy(*order)
        up = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.lag("event").over(w).alias("p"), F.sum("v").over(up).alias("s"), F.max(F.when(F.col("v") > 2, F.col("v"))).over(up).alias("m"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.fixture(scope="module")
def dense(spark):
    """One key has most rows, all on one day and half of them in one second; the others have few, or no time."""
    rng = random.Random(11)
    rows = [(i, 1, rng.choice("abc"), START + timedelta(seconds=7 if i % 2 else rng.randrange(40_000))) for i in range(3000)]
    rows += [(i, rng.choice([2, None]), "d", None if i % 9 == 0 else START + timedelta(days=rng.randrange(9))) for i in range(3000, 3100)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, event string, ts timestamp").repartition(4).cache()


def test_dense_buckets_are_cut_to_a_bound(dense):
    day = F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    for most in (40, 300):
        base, names, parts = ordered._grouped(dense, ["user_id"], ordered.time_bucket(F.col("ts")), ["ts", "event_id"], most)
        sizes = [r["n"] for r in base.groupBy(*names, *parts).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 3100 and max(sizes) <= 2 * most and len(sizes) >= 3000 // (2 * most)
        # Parts are ranges of the order.
        ends = base.where("user_id = 1").groupBy(*names, *parts).agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
        ends = [(tuple(r["a"]), tuple(r["b"])) for r in ends.orderBy(*parts).collect()]
        assert all(b < c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))
    base, _, parts = ordered._grouped(dense, ["user_id"], ordered.time_bucket(F.col("ts")), ["ts", "event_id"], 10_000)
    assert parts == ["_bucket"] and "Join" not in base._jdf.queryExecution().toString()
    assert dense.groupBy("user_id", day).count().agg(F.max("count")).first()[0] == 3000


def test_dense_buckets_change_no_result(dense):
    order, value = ["ts", "event_id"], F.col("event_id") % 7
    w = Window.partitionBy("user_id").orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    want = dense.select("*", F.lag("event").over(w).alias("p"), F.sum(value).over(up).alias("s"), F.max(value).over(up).alias("m"))
    got = ordered_columns(dense, ["user_id"], order, ordered.time_bucket(F.col("ts")), lag={"p": "event"}, sums={"s": value}, maxes={"m": value}, most_rows=64)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    timed = dense.where("ts IS NOT NULL")
    for ask in (time_on_task, navigation_transitions, navigation_trace, attention):
        plain, cut = (sorted(map(repr, ask(timed, most_rows=most).collect())) for most in (None, 64))
        assert plain == cut
    states = dense.withColumn("state", F.format_string('{"%s":%d}', "event", value))
    plain, cut = (sorted(map(repr, snapshot_diff(states, "state", "ts", "event_id", keys=["user_id"], most_rows=m).collect())) for m in (None, 64))
    assert plain == cut


def test_places_among_splitters(spark):
    rng = random.Random(2)
    rows = [(sorted(rng.sample(range(60), rng.randrange(20))) if i % 10 else None, rng.randrange(-2, 62)) for i in range(500)]
    df = spark.createDataFrame(rows, "s array<int>, at int")
    got = df.select("s", "at", ordered._place(F.col("s"), F.col("at")).alias("place")).collect()
    assert all(r.place == sum(x <= r.at for x in r.s or []) for r in got)


def test_ordered_columns_keep_null_lag_values(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 11, "c"), (1, 12, "d")], "k int, pos bigint, v string")
    got = ordered_columns(df, ["k"], ["pos"], position_bucket(F.col("pos"), 10), lag={"p": "v"})
    assert [r.p for r in got.orderBy("pos").collect()] == [None, "a", None, "c"]


@pytest.mark.parametrize("bucket_seconds", [600, 86_400])
def test_time_on_task(log, log_rows, rows, bucket_seconds):
    want = []
    for user, sessions in sessions_of(log_rows).items():
        active = sum((s[-1][1] - s[0][1]).total_seconds() for s in sessions)
        want.append((user, len(sessions), int(active * 1_000_000)))
    assert rows(time_on_task(log, bucket_seconds=bucket_seconds)) == sorted(want, key=repr)


def test_time_on_task_by_session(spark, rows):
    log = spark.createDataFrame(
        [(1, "a", START), (1, "a", START + timedelta(seconds=5)), (1, "b", START + timedelta(days=2))], "user_id int, session string, ts timestamp"
    )
    assert rows(time_on_task_by_session(log)) == [(1, 2, 5_000_000)]


def test_navigation(log, log_rows, rows):
    steps, moves = [], {}
    for user, sessions in sessions_of(log_rows).items():
        for n, session in enumerate(sessions, 1):
            for k, (event, _, i) in enumerate(session, 1):
                steps.append((i, user, n, k))
            for a, b in zip(session, session[1:]):
                moves[a[0], b[0]] = moves.get((a[0], b[0]), 0) + 1
    assert rows(navigation_trace(log, bucket_seconds=3600), "event_id", "user_id", "session_no", "step") == sorted(steps, key=repr)
    assert rows(navigation_transitions(log)) == sorted((a, b, n) for (a, b), n in moves.items())


def test_attention(log, log_rows, rows):
    want = {}
    for sessions in sessions_of(log_rows).values():
        for session in sessions:
            for (event, at, _), nxt in zip(session, session[1:] + [None]):
                n, micros = want.get(event, (0, 0))
                want[event] = (n + 1, micros + (int((nxt[1] - at).total_seconds() * 1e6) if nxt else 0))
    assert rows(attention(log)) == sorted((e, n, m) for e, (n, m) in want.items())


def test_event_flags(log, log_rows, rows):
    want = {}
    for _, user, event, _ in log_rows:
        a, b = want.get(user, (0, 0))
        want[user] = (a + (event == "open"), b + (event == "drag"))
    assert rows(event_flags_per_user(log, {"opened": "open", "drags": "drag"})) == sorted(((u, *v) for u, v in want.items()), key=repr)


HISTORY = "source_key string, remote_endpoint string, question_id string, n int, state string, ts timestamp"


def test_history(spark, rows):
    def at(d):
        return START + timedelta(days=d)

    h = spark.createDataFrame([
        ("s", "e1", "q", 1, '{"a":1,"b":2}', at(0)), ("s", "e1", "q", 2, '{"a":1,"c":{"x":1}}', at(1)), ("s", "e1", "q", 3, None, at(5)),
        ("s", "e1", "q", 4, '{"a":1}', at(5.1)), ("s", "e1", "q", 5, '{"a":"1"}', at(9)), ("s", "e2", "q", 6, "broken", at(2)),
    ], HISTORY)
    assert rows(last_n_snapshots(h, 2, ["ts", "n"]), "n", "rn") == [(4, 2), (5, 1), (6, 1)]
    assert rows(revision_counts(h), "remote_endpoint", "snapshots", "revised") == [("e1", 5, True), ("e2", 1, False)]
    diff = snapshot_diff(h, "state", "ts", "n")
    assert rows(diff, "n", "added", "dropped", "changed") == [
        (1, ["a", "b"], [], []), (2, ["c"], ["b"], []), (3, [], ["a", "c"], []), (4, ["a"], [], []), (5, [], [], ["a"]), (6, [], [], []),
    ]


def test_last_n_prunes_before_the_shuffle(spark):
    h = spark.createDataFrame([("s", "e", "q", 1, "{}", START)], HISTORY).repartition(3)
    plan = last_n_snapshots(h, 2, ["ts", "n"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_answers(spark, rows):
    a = spark.createDataFrame([("q1", "3", 1), ("q1", "3", 2), ("q1", "", 2), ("q1", "x", None), ("q2", None, 1)], "question_id string, answer string, user_id int")
    assert [tuple(r) for r in responses_per_question(a).collect()] == [("q1", 4), ("q2", 1)]
    assert rows(answer_distribution(a, "answer")) == sorted([("q1", "3", 2, 3.0), ("q1", None, 1, None), ("q1", "x", 1, None), ("q2", None, 1, None)], key=repr)
    assert rows(answer_totals(a, "answer")) == [("q1", 3, 1, 6.0), ("q2", 0, 1, None)]
    assert rows(distinct_learners(a, by=["question_id"])) == [("q1", 2), ("q2", 1)]
    correct = spark.createDataFrame([("q1", "3")], "question_id string, correct string")
    assert rows(correct_counts(a, correct, ["question_id"])) == [("q1", 4, 2)]


def test_compare_and_unite_datasets(spark, rows):
    a = spark.createDataFrame([("k1", 1, None), ("k2", 2, "x"), ("k3", 3, "y")], "k string, n int, t string")
    b = spark.createDataFrame([("k1", 1, None), ("k2", 2, None), ("k4", 4, "z")], "k string, n int, t string")
    assert rows(compare_datasets(a, b, ["k"], ["n", "t"]), "k", "status") == [("k1", "same"), ("k2", "changed"), ("k3", "only_a"), ("k4", "only_b")]
    u = union_datasets({"fall": a.select("k", "n"), "spring": b.select("k", F.col("t").alias("n"), F.lit(True).alias("f"))})
    assert rows(u, "dataset", "k", "n", "f")[0] == ("fall", "k1", "1", None) and dict(u.dtypes)["n"] == "string"


def test_union_by_name_never_forces_text_to_numbers(spark, rows):
    a = spark.createDataFrame([(1, True)], "x bigint, y boolean")
    b = spark.createDataFrame([("t", 2.5, "z")], "x string, y double, z string")
    assert rows(union_by_name([a, b])) == [("1", 1.0, None), ("t", 2.5, "z")]
