"""Column expressions.  Everything here is built from JVM-side functions; there is no UDF."""

from .identity import (
    ANSWER_KEY,
    HISTORY_KEY,
    attachment_file,
    file_id12,
    identity_key,
    key_columns,
    normalized,
)
from .jsons import filter_labels, is_json, json_get, json_items, state_markers, try_json
from .text import (
    PSEUDO_HEADERS,
    REPORT_TYPES,
    is_text_content_type,
    report_type_from_slug,
    sanitize_filename,
    state_text,
)
from .values import epoch_millis_to_ts, epoch_seconds_to_ts, json_value, rfc3339, try_number

__all__ = [
    "ANSWER_KEY", "HISTORY_KEY", "PSEUDO_HEADERS", "REPORT_TYPES",
    "attachment_file", "epoch_millis_to_ts", "epoch_seconds_to_ts", "file_id12",
    "filter_labels", "identity_key", "is_json", "is_text_content_type", "json_get",
    "json_items", "json_value", "key_columns", "normalized", "report_type_from_slug",
    "rfc3339", "sanitize_filename", "state_markers", "state_text", "try_json", "try_number",
]
