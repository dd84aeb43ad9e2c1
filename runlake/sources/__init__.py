"""Readers and writers at the edges of a dataset."""

from .csv_splits import csv_lines, csv_records, split_cells
from .csvs import failed_casts, has_multiline_cells, read_cells, scan_report_csv
from .export import collect_capped, json_friendly, write_result
from .files import arrow_opens, list_files, read_chosen_texts, read_text_files, text_chunks
from .records import (
    append_batches, append_records, read_batches, read_membership, read_record_lines, read_segments, read_store, record_lines, stamp, type_records,
    typed_empty, with_identity, write_membership, write_store,
)

__all__ = [
    "append_batches", "append_records", "arrow_opens", "collect_capped", "csv_lines", "csv_records", "failed_casts", "has_multiline_cells", "json_friendly", "list_files", "read_batches", "read_cells", "read_chosen_texts",
    "read_membership", "read_record_lines", "read_segments", "read_store", "read_text_files", "record_lines",
    "scan_report_csv", "split_cells", "stamp", "type_records", "text_chunks", "typed_empty", "with_identity", "write_membership",
    "write_result", "write_store",
]
