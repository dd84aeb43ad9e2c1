"""Decode the doubly encoded ``report_state`` of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_json


def _text_of(value: Column) -> Column:
    """Text of a JSON string; JSON null counts as empty text; NULL for other kinds."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "VOID", F.lit(""))


def _object_or_null(text: Column, parsed: Column) -> Column:
    """Whether text is one JSON object or the JSON null; NULL where there is no text."""
    # That JSON is an object shows in its first character, without a look at all its fields.
    is_object = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    good = is_json(text, parsed) & (is_object | F.coalesce(F.is_variant_null(parsed), F.lit(False)))
    return F.when(text.isNotNull(), good)


def double_decode(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``report_state``, ``report_state_raw``, ``interactive_state_raw``, ``_decode_error``.

    ``report_state`` is a JSON string holding an object whose ``interactiveState`` is again
    a JSON string.  The outer text failing to decode leaves the state NULL and keeps the
    text in ``report_state_raw``; the inner one failing leaves ``interactiveState`` null and
    keeps its text in ``interactive_state_raw``; both set ``_decode_error``.  A state that
    is no string stays as it is and an absent one stays NULL.  The record text itself is
    never rewritten, so no other field changes.
    """
    # One step per parse: each text is parsed once and later steps refer to the result.
    state = F.try_variant_get(F.try_parse_json(F.col(record)), "$.report_state", "variant")
    step = records.withColumn("_state", state)
    step = step.withColumn("_outer", _text_of(F.col("_state")))
    step = step.withColumn("_outer_json", F.try_parse_json("_outer"))
    step = step.withColumn("_outer_ok", _object_or_null(F.col("_outer"), F.col("_outer_json")))
    fields = F.try_variant_get("_outer_json", "$", "map<string,variant>")
    step = step.withColumn("_fields", F.when(F.col("_outer_ok"), fields))
    step = step.withColumn(
        "_inner",
        F.when(F.map_contains_key("_fields", "interactiveState"), _text_of(F.try_element_at("_fields", F.lit("interactiveState")))),
    )
    step = step.withColumn("_inner_json", F.try_parse_json("_inner"))
    step = step.withColumn("_inner_ok", _object_or_null(F.col("_inner"), F.col("_inner_json")))
    inner = F.when(F.col("_inner_ok"), F.col("_inner_json")).otherwise(F.parse_json(F.lit("null")))
    replaced = F.map_concat(
        F.map_filter("_fields", lambda k, v: k != "interactiveState"),
        F.create_map(F.lit("interactiveState"), inner),
    )
    fields = F.when(F.col("_inner").isNotNull(), replaced).otherwise(F.col("_fields"))
    decoded = (
        F.when(F.col("_outer").isNull() & ~F.is_variant_null("_state"), F.to_json("_state"))
        .when(F.col("_outer_ok"), F.to_json(fields))
    )
    failed = ~F.coalesce("_outer_ok", F.lit(True)) | ~F.coalesce("_inner_ok", F.lit(True))
    return step.select(
        *records.columns,
        decoded.alias("report_state"),
        F.when(~F.col("_outer_ok"), F.col("_outer")).alias("report_state_raw"),
        F.when(~F.col("_inner_ok"), F.col("_inner")).alias("interactive_state_raw"),
        F.when(failed, F.lit(True)).alias("_decode_error"),
    )
