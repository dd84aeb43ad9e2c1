"""Attachment references and files: B7-B9, C4, C7, D11, D12, G6, H4."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attachment_file, file_id12, identity_key, is_text_content_type, key_columns, state_markers, try_json
from .ordered import BLOCK_ROWS, ordered_columns, position_bucket
from .records import run_view

ATTACHMENT_MAP = "map<string,struct<publicPath:string,contentType:string>>"


def attachment_refs(records: DataFrame, record_type: str, position: Column | None = None) -> DataFrame:
    """H4: one row per attachment a record names.

    ``records`` has the identity columns and, as JSON text, ``attachments`` and
    ``report_state``, plus ``id`` for answers.  ``state`` tells whether the state refers to
    the attachment by an ``__attachment__`` marker.  ``position`` fixes the scan order.
    """
    doc_id = F.col("id") if record_type == "answers" else F.col("history_id")
    identity = [F.col(k) for k in key_columns(record_type)]
    if record_type == "answers":
        identity.append(F.lit(None).cast("string").alias("history_id"))
    markers = state_markers(F.col("report_state"))
    entries = F.from_json(F.col("attachments"), ATTACHMENT_MAP)
    # Records without attachments leave before their states are searched.
    rows = records.where(F.col("attachments").isNotNull()).select(
        *identity,
        (position if position is not None else F.lit(0)).cast("bigint").alias("position"),
        F.coalesce(doc_id.cast("string"), F.lit("")).alias("doc_id"),
        markers.alias("_markers"),
        F.explode(entries).alias("name", "_meta"),
    )
    return rows.select(
        F.lit(record_type).alias("collection"),
        F.coalesce("source_key", F.lit("")).alias("source"),
        F.coalesce(F.col("_meta.publicPath"), F.lit("")).alias("public_path"),
        F.coalesce(F.col("_meta.contentType"), F.lit("")).alias("content_type"),
        "name", "doc_id",
        F.array_contains("_markers", F.col("name")).alias("state"),
        "source_key", "remote_endpoint", "question_id", "history_id", "position",
    )


def scan_run_attachments(
    stores: dict[str, DataFrame], membership: DataFrame, run_id: int, position: Column | None = None
) -> DataFrame:
    """C4: the references in the records one run covers, over the store types present."""
    found = [
        attachment_refs(run_view(store, membership, t, run_id), t, position) for t, store in stores.items()
    ]
    if not found:
        raise LookupError(f"run {run_id} has neither answers nor history; merge one first")
    refs = found[0]
    for other in found[1:]:
        refs = refs.unionByName(other)
    return refs


def select_refs(
    refs: DataFrame,
    answer: str | None = None,
    history: str | None = None,
    question: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """References that meet all given selectors."""
    if answer:
        refs = refs.where((F.col("collection") == "answers") & (F.col("doc_id") == answer))
    if history:
        refs = refs.where((F.col("collection") == "history") & (F.col("doc_id") == history))
    if question:
        refs = refs.where(F.col("question_id") == question)
    if name:
        refs = refs.where(F.col("name") == name)
    return refs


def _scan_order() -> Column:
    """Scan position, then the record's identity, so that without positions the order is that of the store."""
    identity = identity_key("source_key", "remote_endpoint", "question_id", "history_id")
    return F.struct("position", identity.alias("identity"), "name", "doc_id", "content_type")


def dedup_refs(refs: DataFrame) -> DataFrame:
    """The first reference in scan order per (source, public path)."""
    rest = [c for c in refs.columns if c not in ("source", "public_path")]
    first = F.min_by(F.struct(*rest), _scan_order()).alias("_first")
    return refs.groupBy("source", "public_path").agg(first).select("source", "public_path", "_first.*").select(*refs.columns)


def pending_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """References whose file is not there yet, which is where an interrupted fetch goes on."""
    named = refs.withColumn("file", attachment_file("source", "public_path", F.col("name")))
    return named.join(files.select("file").distinct(), "file", "left_anti")


def attachment_index(refs: DataFrame, files: DataFrame) -> DataFrame:
    """One row per attachment file that exists.

    ``files`` has ``file`` (base name) and ``size``.  The name and content type come from
    the first reference in scan order, the state flag from any.  References stay a table of
    their own (:func:`attachment_index_refs`), as one file may be named by any number of
    records.
    """
    first = F.min_by(F.struct("name", "content_type"), _scan_order())
    grouped = refs.groupBy("source", "public_path").agg(
        first.alias("_first"), F.bool_or("state").alias("state"), F.count(F.lit(1)).alias("n_refs")
    )
    index = grouped.select(
        file_id12("source", "public_path").alias("id12"),
        F.col("_first.name").alias("name"), "source", "public_path",
        F.col("_first.content_type").alias("content_type"), "state", "n_refs",
        attachment_file("source", "public_path", F.col("_first.name")).alias("file"),
    )
    return index.join(files.select("file", "size"), "file", "inner").select(
        "id12", "name", "source", "public_path", "content_type", "size", "state", "n_refs", "file"
    )


def attachment_index_refs(refs: DataFrame) -> DataFrame:
    """Which record refers to which file, one row per reference."""
    return refs.select(
        file_id12("source", "public_path").alias("id12"), F.col("collection").alias("type"),
        "source_key", "remote_endpoint", "question_id", "history_id",
    )


def unreferenced_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Files no record refers to.  They are reported; deleting is up to the caller."""
    named = refs.select(attachment_file("source", "public_path", F.col("name")).alias("file")).distinct()
    return files.join(named, "file", "left_anti")


def attachment_states(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Content of the files current answers point at, with the parsed state.

    ``texts`` has ``file`` and ``content``; ``state`` is NULL where content is not JSON.
    """
    rows = index.where("state").select("file", "id12", "name").join(texts.select("file", "content"), "file")
    return rows.select(F.col("file").alias("filename"), "id12", "name", "content", try_json(F.col("content")).alias("state"))


def attachment_content(index: DataFrame, texts: DataFrame) -> DataFrame:
    """Content of every text attachment, whatever its state flag."""
    rows = index.where(is_text_content_type(F.col("content_type"))).select(
        "file", "id12", "name", "source", "public_path"
    ).join(texts.select("file", "content"), "file")
    return rows.select(
        "id12", "name", "source", "public_path", F.col("file").alias("filename"), "content",
        try_json(F.col("content")).alias("state"),
    )


def pair_results(refs: DataFrame, results: DataFrame, block: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Fetch results paired with the references they answer, and the failed ones.

    Distinct references may share ``(doc_id, name)``; the k-th result of such a pair belongs
    to its k-th reference.  ``refs`` and ``results`` have ``position``; results carry
    ``url`` and ``error``.  The k is counted in blocks of positions, so a pair shared by a
    third of all rows is numbered by many tasks.
    """
    key = ["doc_id", "name"]

    def numbered(df: DataFrame) -> DataFrame:
        return ordered_columns(
            df, key, ["position"], position_bucket(F.col("position"), block), sums={"k": F.lit(1).cast("bigint")},
            most_rows=None,  # a block of positions has no more rows than positions
        )

    right = numbered(results.select(*key, "position", "url", "error")).drop("position")
    paired = numbered(refs).join(right, [*key, "k"], "inner")
    failed = F.coalesce("error", F.lit("")) != ""
    return paired.where(~failed), paired.where(failed).select(*key, "k", "error")
