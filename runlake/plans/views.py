"""SQL views over datasets: K1, K2."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    attachment_content, attachment_files_dimension, attachment_states, downloads_dimension, report_rows, run_view, union_runs,
)
from ..sources import typed_empty

# Columns of views that have no data yet.
STORE_COLUMNS = {
    "source_key": "VARCHAR", "remote_endpoint": "VARCHAR", "question_id": "VARCHAR", "history_id": "VARCHAR",
    "_fetched_at": "TIMESTAMP", "_run_id": "BIGINT",
}
MEMBERSHIP_COLUMNS = {
    "run_id": "BIGINT", "type": "VARCHAR", "source_key": "VARCHAR", "remote_endpoint": "VARCHAR",
    "question_id": "VARCHAR", "history_id": "VARCHAR",
}
DOWNLOAD_COLUMNS = {"run_id": "BIGINT", "type": "VARCHAR", "slug": "VARCHAR", "report_type": "VARCHAR", "complete": "BOOLEAN"}
INDEX_COLUMNS = {
    "id12": "VARCHAR", "name": "VARCHAR", "source": "VARCHAR", "public_path": "VARCHAR", "content_type": "VARCHAR",
    "size": "BIGINT", "state": "BOOLEAN", "file": "VARCHAR",
}
TEXT_COLUMNS = {"file": "VARCHAR", "content": "VARCHAR"}


@dataclass
class ReportRun:
    """The CSV rows of one report download; ``rows`` has no ``run_id``."""

    run_id: int
    report_type: str
    rows: DataFrame
    job_id: int | None = None


@dataclass
class DatasetFrames:
    """The lazy frames of one dataset, ready to be registered."""

    name: str
    stores: dict[str, DataFrame] = field(default_factory=dict)
    membership: DataFrame | None = None
    member_runs: list[tuple[str, int]] = field(default_factory=list)
    downloads: DataFrame | None = None
    reports: list[ReportRun] = field(default_factory=list)
    attachments: DataFrame | None = None
    texts: DataFrame | None = None


def dataset_views(spark: SparkSession, frames: DatasetFrames) -> dict[str, DataFrame]:
    """All views of one dataset by bare name; what is absent is typed and empty."""

    def or_empty(df: DataFrame | None, columns: dict[str, str]) -> DataFrame:
        return typed_empty(spark, columns) if df is None else df

    plain = {r.run_id: (r.rows, r.report_type) for r in frames.reports if r.job_id is None}
    members = or_empty(frames.membership, MEMBERSHIP_COLUMNS)
    index = or_empty(frames.attachments, INDEX_COLUMNS)
    texts = or_empty(frames.texts, TEXT_COLUMNS)
    run_only = {"run_id": "BIGINT"}
    views = {
        "reports": or_empty(union_runs(plain), run_only),
        "report_prompts": or_empty(union_runs(plain, prompts=True), run_only),
        "answers": or_empty(frames.stores.get("answers"), STORE_COLUMNS),
        "history": or_empty(frames.stores.get("history"), STORE_COLUMNS),
        "run_membership": members,
        "downloads": typed_empty(spark, DOWNLOAD_COLUMNS) if frames.downloads is None else downloads_dimension(frames.downloads),
        "attachment_files": attachment_files_dimension(index),
        "attachment_states": attachment_states(index, texts),
        "attachment_content": attachment_content(index, texts),
    }
    for r in frames.reports:
        name = f"report_{r.run_id}" if r.job_id is None else f"report_{r.run_id}_job_{r.job_id}"
        rows = report_rows(r.rows, r.report_type)
        views[name] = rows.select(F.lit(r.run_id).cast("bigint").alias("run_id"), "*")
    for record_type, run in frames.member_runs:
        views[f"{record_type}_{run}"] = run_view(views[record_type], members, record_type, run)
    return views


def view_prefixes(names: Sequence[tuple[str | None, str]]) -> list[str]:
    """A view prefix for each ``(alias, dataset name)``; a dataset alone needs none.

    Temporary view names ignore case, so prefixes must differ in more; all that clash are reported.
    """
    if len(names) < 2:
        return [""] * len(names)
    chosen = [alias or name for alias, name in names]
    owners: dict[str, list[str]] = {}
    for prefix, (_, name) in zip(chosen, names, strict=True):
        owners.setdefault(prefix.lower(), []).append(name)
    clashes = [f"{prefix}: {', '.join(held)}" for prefix, held in owners.items() if len(held) > 1]
    if clashes:
        raise ValueError(f"datasets share a view prefix, name them apart by aliases ({'; '.join(clashes)})")
    return [f"{prefix}__" for prefix in chosen]


# Views registered by session and prefix, so that those of runs that are gone can be dropped.
_REGISTERED: dict[tuple[str, str], set[str]] = {}


def register_views(spark: SparkSession, datasets: Sequence[tuple[str | None, DatasetFrames]]) -> list[str]:
    """K1: temporary views for one dataset by bare name, for several as ``alias__view``."""
    registered, session = [], spark._jsparkSession.sessionUUID()
    for prefix, (_, frames) in zip(view_prefixes([(a, f.name) for a, f in datasets]), datasets):
        views = dataset_views(spark, frames)
        for gone in _REGISTERED.get((session, prefix), set()) - set(views):
            spark.catalog.dropTempView(prefix + gone)
        _REGISTERED[session, prefix] = set(views)
        for name, df in views.items():
            df.createOrReplaceTempView(f"`{prefix}{name}`")
            registered.append(prefix + name)
    return registered


def sql(spark: SparkSession, query: str) -> DataFrame:
    """K2: user SQL over the registered views, planned by Spark as it is."""
    return spark.sql(query)
