"""Report CSV rows: B1-B3, B5, C5, C6, G1."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import PSEUDO_HEADERS, REPORT_TYPES
from .inference import common_type

# Fixed value: how positional report columns are named.
POSITIONAL = re.compile(r"^res_(\d+)_(.+)_([^_]+)$")
ENDPOINT = re.compile(r"^res_(\d+)_remote_endpoint$")


def report_rows(df: DataFrame, report_type: str) -> DataFrame:
    """B1: data rows.  Answers reports lose their pseudo-header rows, and with them any row
    without a student id; other types keep all rows."""
    if report_type != "answers":
        return df
    if "student_id" not in df.columns:
        return _no_students(df)
    return df.where(~F.col("student_id").cast("string").isin(*PSEUDO_HEADERS))


def report_prompts(df: DataFrame, report_type: str) -> DataFrame:
    """B2: only the pseudo-header rows, which only answers reports have."""
    if report_type != "answers":
        return df.where(F.lit(False))
    if "student_id" not in df.columns:
        return _no_students(df)
    return df.where(F.col("student_id").cast("string").isin(*PSEUDO_HEADERS))


def _no_students(df: DataFrame) -> DataFrame:
    warnings.warn("an answers report without a student_id column contributes no rows", stacklevel=3)
    return df.where(F.lit(False))


def quarantine(downloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Downloads split in those of a known report type and the rest."""
    known = F.coalesce(F.col("report_type").isin(*REPORT_TYPES), F.lit(False))
    return downloads.where(known), downloads.where(~known)


def recover_report_type(cells: DataFrame) -> DataFrame:
    """``report_type, recovered`` of a CSV whose provenance is lost.

    Without a student id column it is a log; with pseudo-header rows it is an answers
    report; what remains is marked as recovered.
    """
    if "student_id" not in cells.columns:
        return cells.sparkSession.createDataFrame([("log", False)], "report_type string, recovered boolean")
    pseudo = F.coalesce(F.bool_or(F.col("student_id").isin(*PSEUDO_HEADERS)), F.lit(False))
    return cells.agg(pseudo.alias("answers")).select(
        F.when(F.col("answers"), "answers").otherwise("recovered").alias("report_type"),
        (~F.col("answers")).alias("recovered"),
    )


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: union by column name; a column a frame lacks is NULL in its rows.

    A column the frames declare with differing types is first cast to the type that holds
    all of them, as a number would otherwise be forced on text and fail at run time.
    """
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, dtype in frame.dtypes:
            types.setdefault(name, set()).add(dtype)
    target = {name: common_type(seen) for name, seen in types.items() if len(seen) > 1}

    def aligned(frame: DataFrame) -> DataFrame:
        casts = {n: F.col(f"`{n}`").cast(target[n]) for n, t in frame.dtypes if n in target and t != target[n]}
        return frame.withColumns(casts) if casts else frame

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(aligned, frames))


def union_runs(runs: Mapping[int, tuple[DataFrame, str]], prompts: bool = False) -> DataFrame | None:
    """The ``reports`` or ``report_prompts`` union over ``run -> (rows, report type)``.

    Runs of unknown type are left out with a warning; ``run_id`` is always a bigint.
    """
    unknown = sorted((run, rtype) for run, (_, rtype) in runs.items() if rtype not in REPORT_TYPES)
    if unknown and not prompts:
        warnings.warn(f"report runs of unknown type contribute no rows: {unknown}", stacklevel=2)
    pick = report_prompts if prompts else report_rows
    frames = [
        pick(df, rtype).select(F.lit(run).cast("bigint").alias("run_id"), "*")
        for run, (df, rtype) in runs.items()
        if (rtype == "answers" if prompts else rtype in REPORT_TYPES)
    ]
    return union_by_name(frames) if frames else None


def answers_long(
    reports: DataFrame, fields: Sequence[str] = ("answer",), carry: Sequence[str] = ("run_id", "student_id")
) -> DataFrame:
    """C5, first half: positional report columns as rows.

    ``res_<N>_<question>_<field>`` becomes one row with ``n, remote_endpoint, question_id``
    and ``<field>`` columns.  N is positional within a run, so rows keep their ``run_id``.
    """
    endpoints = {m.group(1) for c in reports.columns if (m := ENDPOINT.match(c))}
    cells: dict[tuple[str, str], dict[str, str]] = {}
    for c in reports.columns:
        m = POSITIONAL.match(c)
        if m and not ENDPOINT.match(c) and m.group(3) in fields:
            cells.setdefault((m.group(1), m.group(2)), {})[m.group(3)] = c
    rows = [
        F.struct(
            F.lit(int(n)).cast("bigint").alias("n"),
            (F.col(f"res_{n}_remote_endpoint") if n in endpoints else F.lit(None)).cast("string").alias("remote_endpoint"),
            F.lit(question).alias("question_id"),
            *[(F.col(f"`{cols[f]}`") if f in cols else F.lit(None)).cast("string").alias(f) for f in fields],
        )
        for (n, question), cols in cells.items()
    ]
    if not rows:
        raise ValueError("the report has no res_<N>_<question>_<field> columns")
    return reports.select(*carry, F.inline(F.array(*rows)))


def answers_long_of_runs(
    runs: Mapping[int, DataFrame], fields: Sequence[str] = ("answer",), carry: Sequence[str] = ("student_id",)
) -> DataFrame:
    """C5 over many runs: each report is melted on its own columns, then the long forms are united.

    A run pays for its own questions only, and its N is never read with another run's columns.
    """
    melted = [answers_long(df, fields, carry).select(F.lit(run).cast("bigint").alias("run_id"), "*") for run, df in runs.items()]
    return union_by_name(melted)


def reports_to_answers(long: DataFrame, answers: DataFrame) -> DataFrame:
    """C5, second half: report cells joined to their stored answer records."""
    return long.where(F.col("remote_endpoint").isNotNull()).join(answers, ["remote_endpoint", "question_id"], "inner")


def learners(reports: DataFrame, ids: Sequence[str] = ("user_id",)) -> DataFrame:
    """Endpoint to person, once per endpoint, from the positional endpoint columns.

    Of several rows that name an endpoint the one with most ids counts, then that of the latest run,
    then the greatest ids.
    """
    names = [c for c in reports.columns if ENDPOINT.match(c)]
    endpoint = F.explode(F.array(*[F.col(c).cast("string") for c in names])).alias("remote_endpoint")
    run = F.col("run_id").cast("bigint") if "run_id" in reports.columns else F.lit(0).cast("bigint")
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in ids])
    named = reports.select(endpoint, F.struct(known.alias("_known"), run.alias("_run"), *ids).alias("_who"))
    best = named.where(F.col("remote_endpoint").isNotNull()).groupBy("remote_endpoint").agg(F.max("_who").alias("_who"))
    return best.select("remote_endpoint", *[F.col("_who").getField(c).alias(c) for c in ids])


def attach_learner(answers: DataFrame, reports: DataFrame, ids: Sequence[str] = ("user_id",)) -> DataFrame:
    """Answers with the person behind their endpoint, NULL where no report names it."""
    return answers.join(learners(reports, ids), "remote_endpoint", "left")
