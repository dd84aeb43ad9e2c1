"""Record identity (H1) and attachment file identity (H2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sanitize_filename

ANSWER_KEY = ("source_key", "remote_endpoint", "question_id")
HISTORY_KEY = ANSWER_KEY + ("history_id",)


def key_columns(record_type: str) -> tuple[str, ...]:
    """Identity columns of a record type (``answers`` or ``history``)."""
    if record_type == "answers":
        return ANSWER_KEY
    if record_type == "history":
        return HISTORY_KEY
    raise ValueError(f"unknown record type {record_type!r}")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c: Column | str) -> Column:
    """An identity field as it counts for merging: absent equals empty."""
    return F.coalesce(_col(c), F.lit(""))


def identity_key(*fields: Column | str) -> Column:
    """H1: one ``<byte length>:<bytes>`` token per field, joined.

    The length prefix makes the text injective, and Spark's binary string order makes it a
    total order, so it serves as the sort key of a store.
    """
    tokens: list[Column] = []
    for f in fields:
        value = normalized(f)
        tokens += [F.octet_length(value).cast("string"), F.lit(":"), value]
    return F.concat(*tokens)


def file_id12(source: Column | str, public_path: Column | str) -> Column:
    """H2: first 12 hex digits of sha256 over ``source|public_path``."""
    return F.substring(F.sha2(F.concat(_col(source), F.lit("|"), _col(public_path)), 256), 1, 12)


def attachment_file(source: Column | str, public_path: Column | str, name: Column | str) -> Column:
    """File name an attachment is kept under: id, underscore, sanitized name."""
    return F.concat(file_id12(source, public_path), F.lit("_"), sanitize_filename(_col(name)))
