"""The questions users ask of reports, answers, logs and histories: C8, D8-D10, D13, D15, E1-E6."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import key_columns, try_number
from .ordered import BLOCK_ROWS, DAY_SECONDS, ordered_columns, session_columns, time_bucket

SESSION_GAP_SECONDS = 1800


# ---- answers ---------------------------------------------------------------------------


def responses_per_question(answers: DataFrame) -> DataFrame:
    """Answers per question, most answered first."""
    return answers.groupBy("question_id").agg(F.count(F.lit(1)).alias("answered")).orderBy(F.desc("answered"), "question_id")


def answer_distribution(answers: DataFrame, value: str, question: str = "question_id") -> DataFrame:
    """How often each answer was given per question; blank answers count as NULL.

    ``numeric`` is the answer as a number, NULL where it holds other text.
    """
    text = F.nullif(F.col(value).cast("string"), F.lit(""))
    return answers.groupBy(question, text.alias("answer")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "numeric", try_number(F.col("answer"))
    )


def answer_totals(answers: DataFrame, value: str, question: str = "question_id") -> DataFrame:
    """Answered, blank and numeric sum per question."""
    text = F.nullif(F.col(value).cast("string"), F.lit(""))
    return answers.groupBy(question).agg(
        F.count(text).alias("answered"),
        F.count_if(text.isNull()).alias("blank"),
        F.sum(try_number(text)).alias("total"),
    )


def correct_counts(long: DataFrame, correct: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per question how many answers equal the ``correct`` text from the prompt rows.

    ``long`` has the ``on`` columns and ``answer``; ``correct`` has them and ``correct``.
    Answers are counted by text first, so the join meets each distinct text once.
    """
    texts = long.groupBy(*on, "answer").agg(F.count(F.lit(1)).alias("n"))
    return texts.join(correct, list(on), "inner").groupBy(*on).agg(
        F.sum(F.when(F.col("answer").isNotNull(), F.col("n")).otherwise(0)).alias("answered"),
        F.sum(F.when(F.col("answer") == F.col("correct"), F.col("n")).otherwise(0)).alias("correct"),
    )


def distinct_learners(df: DataFrame, learner: str = "user_id", by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """People, counted by portal user."""
    count = F.approx_count_distinct(learner) if approximate else F.count_distinct(learner)
    return df.groupBy(*by).agg(count.alias("learners"))


def engagement_by_group(measures: DataFrame, roster: DataFrame, key: str, by: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Measures added up per class, school or teacher of a roster.

    ``totals`` are sums over ``measures``.  They are added up per learner before the roster
    join, so a learner with a third of all rows meets the join once.
    """
    per_key = measures.groupBy(key).agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    return per_key.join(roster, key, "inner").groupBy(*by).agg(
        F.count(F.lit(1)).alias("learners"), *[F.sum(n).alias(n) for n in totals]
    )


def join_external(view: DataFrame, external: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A view joined to a roster or rubric from outside the dataset.

    No broadcast hint: the engine broadcasts the outside table when it measures below the
    session's threshold and otherwise shuffles and splits skewed keys.
    """
    return view.join(external, list(on), how)


# ---- logs ------------------------------------------------------------------------------


def event_flags_per_user(log: DataFrame, flags: Mapping[str, str], user: str = "user_id") -> DataFrame:
    """Per user how often each flagged event occurred; ``flags`` maps column to event."""
    return log.groupBy(user).agg(*[F.count_if(F.col("event") == e).alias(n) for n, e in flags.items()])


def with_previous_event(
    log: DataFrame,
    user: Sequence[str] = ("user_id",),
    ts: str = "ts",
    tie: str = "event_id",
    event: str = "event",
    gap_seconds: int = SESSION_GAP_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
    most_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Each event with the one before it: ``prev_event``, ``gap_micros``, ``new_session``.

    A session starts at a user's first event and after each gap longer than
    ``gap_seconds``.  With a session id column, put it into ``user``.
    """
    rows = ordered_columns(
        log, user, [ts, tie], time_bucket(F.col(ts), bucket_seconds), lag={"prev_event": event, "_prev_ts": ts},
        most_rows=most_rows,
    )
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_prev_ts").cast("timestamp"))
    rows = rows.withColumn("gap_micros", gap).drop("_prev_ts")
    fresh = F.col("gap_micros").isNull() | (F.col("gap_micros") > gap_seconds * 1_000_000)
    return rows.withColumn("new_session", fresh)


def time_on_task(log: DataFrame, user: Sequence[str] = ("user_id",), **options) -> DataFrame:
    """Sessions and active time per user.

    The span of a session is the sum of the gaps inside it, so adding up the gaps that do
    not start a session gives the time on task without numbering the sessions.
    """
    rows = with_previous_event(log, user=user, **options)
    return rows.groupBy(*user).agg(
        F.count_if("new_session").alias("sessions"),
        F.sum(F.when(~F.col("new_session"), F.col("gap_micros")).otherwise(0)).alias("active_micros"),
    )


def time_on_task_by_session(log: DataFrame, user: Sequence[str] = ("user_id",), session: str = "session", ts: str = "ts") -> DataFrame:
    """E2 for logs that carry a session id: last minus first event of each session, added up."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = log.groupBy(*user, session).agg((F.max(micros) - F.min(micros)).alias("span"))
    return spans.groupBy(*user).agg(F.count(F.lit(1)).alias("sessions"), F.sum("span").alias("active_micros"))


def navigation_transitions(log: DataFrame, event: str = "event", **options) -> DataFrame:
    """How often one event follows another within a session."""
    rows = with_previous_event(log, event=event, **options).where(~F.col("new_session"))
    return rows.groupBy(F.col("prev_event").alias("from_event"), F.col(event).alias("to_event")).agg(
        F.count(F.lit(1)).alias("n")
    )


def navigation_trace(
    log: DataFrame,
    user: Sequence[str] = ("user_id",),
    ts: str = "ts",
    tie: str = "event_id",
    event: str = "event",
    gap_seconds: int = SESSION_GAP_SECONDS,
    bucket_seconds: int = DAY_SECONDS,
    most_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Each event with its session number and step within the session, as rows."""
    return session_columns(log, user, ts, tie, event, gap_seconds, bucket_seconds, most_rows)


def attention(log: DataFrame, target: str = "event", user: Sequence[str] = ("user_id",), **options) -> DataFrame:
    """Events on each target and the time until the next event of the same session.

    Seen from the later event, that time belongs to the target of the event before it; both
    contributions of a row are emitted side by side and added up in one aggregate.
    """
    rows = with_previous_event(log, user=user, event=target, **options)
    none = F.lit(0).cast("bigint")
    focus = F.when(~F.col("new_session"), F.col("gap_micros")).otherwise(none)
    parts = F.array(
        F.struct(F.col(target).alias("target"), F.lit(1).cast("bigint").alias("n"), none.alias("micros")),
        F.struct(F.col("prev_event").alias("target"), none.alias("n"), focus.alias("micros")),
    )
    return rows.select(F.inline(parts)).where(F.col("target").isNotNull()).groupBy("target").agg(
        F.sum("n").alias("events"), F.sum("micros").alias("focus_micros")
    )


# ---- history ---------------------------------------------------------------------------


def last_n_snapshots(history: DataFrame, n: int, order: Sequence[str], record_type: str = "answers") -> DataFrame:
    """The newest n snapshots of each answer, newest first in ``rn``.

    The rank filter sits on the window, so Spark keeps at most n rows per key in each task
    before the shuffle.
    """
    w = Window.partitionBy(*key_columns(record_type)).orderBy(*[F.desc(c) for c in order])
    return history.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def revision_counts(history: DataFrame, record_type: str = "answers") -> DataFrame:
    """E5: snapshots per answer and whether it was revised."""
    return history.groupBy(*key_columns(record_type)).agg(F.count(F.lit(1)).alias("snapshots")).withColumn(
        "revised", F.col("snapshots") > 1
    )


def snapshot_diff(
    history: DataFrame,
    state: str,
    ts: str,
    tie: str,
    keys: Sequence[str] | None = None,
    bucket: Column | None = None,
    most_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Per snapshot the state keys added, removed and changed since the one before.

    ``state`` is JSON object text.  The first snapshot of an answer adds all its keys.
    """
    keys = list(keys or key_columns("answers"))
    rows = ordered_columns(
        history, keys, [ts, tie], time_bucket(F.col(ts)) if bucket is None else bucket, lag={"_before": state},
        most_rows=most_rows,
    )

    def fields(text: str) -> Column:
        values = F.try_variant_get(F.try_parse_json(F.col(text)), "$", "map<string,variant>")
        return F.coalesce(
            F.transform_values(values, lambda k, v: F.to_json(v)), F.create_map().cast("map<string,string>")
        )

    rows = rows.withColumns({"_now": fields(state), "_then": fields("_before")}).drop("_before")

    def only_in(a: str, b: str) -> Column:
        return F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))

    both = F.array_intersect(F.map_keys("_now"), F.map_keys("_then"))
    changed = F.filter(both, lambda k: ~F.col("_now")[k].eqNullSafe(F.col("_then")[k]))
    return rows.withColumns(
        {"added": only_in("_now", "_then"), "dropped": only_in("_then", "_now"), "changed": F.array_sort(changed)}
    ).drop("_now", "_then")
