"""Incremental ingest on Structured Streaming."""

from .ingest import ingest_landing, ingest_pages, merge_landing, merge_stream

__all__ = ["ingest_landing", "ingest_pages", "merge_landing", "merge_stream"]
