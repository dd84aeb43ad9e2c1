"""Text classification and cleaning: H3, H12, B4, B6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report vocabulary.
SLUG_TYPES = {
    "student-answers": "answers",
    "student-assignment-usage": "usage",
    "student-actions": "log",
    "student-actions-with-metadata": "log",
    "teacher-actions": "log",
}
REPORT_TYPES = ("answers", "usage", "log", "recovered")
PSEUDO_HEADERS = ("Prompt", "Correct answer")
# Content types that hold text.
TEXT_TYPES = r"^text/|json|xml|csv|svg"
# Device names that are reserved whatever their extension; also the empty name.
NEEDS_PREFIX = r"(?i)^(?=$|(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$))"


def sanitize_filename(name: Column) -> Column:
    """H3: a portable base name made only of ``[A-Za-z0-9._-]``."""
    tail = F.lit(". ")
    base = F.substring_index(F.translate(name, "\\", "/"), "/", -1)
    base = F.rtrim(F.regexp_replace(F.rtrim(base, tail), r"[^A-Za-z0-9._-]", "_"), tail)
    # One zero-width match at the start inserts the prefix, so the base is computed once.
    return F.regexp_replace(base, NEEDS_PREFIX, "_")


def is_text_content_type(content_type: Column) -> Column:
    """Whether a content type promises text; unknown or blank does not."""
    return F.coalesce(F.lower(content_type).rlike(TEXT_TYPES), F.lit(False))


def report_type_from_slug(slug: Column, server_type: Column | None = None) -> Column:
    """The server's type if given, else the slug's type, else the slug itself."""
    known = F.lit(None).cast("string")
    for name, report_type in SLUG_TYPES.items():
        known = F.when(slug == name, report_type).otherwise(known)
    choices = [known, slug]
    if server_type is not None:
        choices.insert(0, F.nullif(server_type, F.lit("")))
    return F.coalesce(*choices)


def state_text(state: Column) -> Column:
    """Query state for display; absent or empty shows as ``(none)``."""
    return F.coalesce(F.nullif(state, F.lit("")), F.lit("(none)"))
