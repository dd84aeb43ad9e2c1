"""Type inference over all rows: A2, A4 and the widening rules.

Each cell's kind is one bit; a column's kinds are OR-ed together.  The fold does not depend
on order, runs as one hash aggregate with partial results per task, and ships only one
number per column and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import PSEUDO_HEADERS

BIGINT, DOUBLE, BOOLEAN, VARCHAR, JSON = 1, 2, 4, 8, 16

# How a CSV cell reads as an integer and as a float.
INTEGER_CELL = r"^[+-]?[0-9]+$"
DECIMAL_CELL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DIGITS = r"[0-9a-fA-F]+(?:_[0-9a-fA-F]+)*"
SPECIAL_CELL = rf"^(?:[+-]?(?i:inf|infinity)|(?i:nan)|[+-]?0[xX]_?(?:{DIGITS}\.?(?:{DIGITS})?|\.{DIGITS})[pP][+-]?[0-9]+)$"

# Store columns whose type does not depend on the data.
PINNED = {
    "source_key": "VARCHAR",
    "remote_endpoint": "VARCHAR",
    "question_id": "VARCHAR",
    "history_id": "VARCHAR",
    "_fetched_at": "TIMESTAMP",
    "_run_id": "BIGINT",
    "_decode_error": "BOOLEAN",
    "report_state": "JSON",
    "report_state_raw": "VARCHAR",
    "interactive_state_raw": "VARCHAR",
    "answer": "JSON",
}


def csv_cell_kind(cell: Column) -> Column:
    """Kind bit of a CSV cell; an empty or absent cell has no vote."""
    # The first character rules out most kinds without a pattern.  A failing cast is far
    # dearer than a pattern, so casts see only cells that look right: up to 18 digits always
    # fit, and a decimal always parses but may be infinite.
    lead = F.substring(cell, 1, 1)
    special = F.when(cell.rlike(SPECIAL_CELL), DOUBLE).otherwise(VARCHAR)
    number = (
        F.when(cell.rlike(INTEGER_CELL) & ((F.length(cell) <= 18) | cell.try_cast("bigint").isNotNull()), BIGINT)
        .when(cell.rlike(DECIMAL_CELL), F.when(F.abs(cell.try_cast("double")) < float("inf"), DOUBLE).otherwise(VARCHAR))
        .otherwise(special)
    )
    return (
        F.when(cell.isNull() | (cell == ""), 0)
        .when(lead.isin(*"0123456789+-."), number)
        .when(lead.isin(*"tTfF"), F.when(F.lower(cell).isin("true", "false"), BOOLEAN).otherwise(VARCHAR))
        .when(lead.isin(*"iInN"), special)
        .otherwise(VARCHAR)
    )


def csv_type(kinds: Column) -> Column:
    """Column type for the kinds seen: integers widen to floats, other mixes to text."""
    return (
        F.when(kinds == BIGINT, "BIGINT")
        .when(kinds.isin(DOUBLE, BIGINT | DOUBLE), "DOUBLE")
        .when(kinds == BOOLEAN, "BOOLEAN")
        .otherwise("VARCHAR")
    )


def describe_csv(cells: DataFrame, report_type: str = "") -> DataFrame:
    """A2 and D5 in one pass: ``row_count`` and ``columns`` in file order.

    ``columns`` is an array of ``column, position, type``; ``cells`` is an all-text frame.
    """
    # Kinds as one array: a wide report does not make one huge generated method.
    kinds = F.transform(F.array(*[F.col(_q(c)).cast("string") for c in cells.columns]), csv_cell_kind)
    folded = cells.select(kinds.alias("_k"), _is_data_row(cells, report_type).alias("_data")).agg(
        F.count_if("_data").alias("row_count"),
        *[F.bit_or(F.col("_k")[i]).alias(f"c{i}") for i in range(len(cells.columns))],
    )
    columns = [
        F.struct(F.lit(c).alias("column"), F.lit(i).cast("bigint").alias("position"), csv_type(F.col(f"c{i}")).alias("type"))
        for i, c in enumerate(cells.columns)
    ]
    return folded.select("row_count", F.array(*columns).alias("columns"))


def infer_csv_schema(cells: DataFrame) -> DataFrame:
    """A2: ``column, position, type`` for an all-text frame, in column order."""
    return describe_csv(cells).select(F.inline("columns"))


def _is_data_row(cells: DataFrame, report_type: str) -> Column:
    if report_type != "answers" or "student_id" not in cells.columns:
        return F.lit(True)
    return ~F.coalesce(F.col("student_id").cast("string").isin(*PSEUDO_HEADERS), F.lit(False))


def data_row_count(cells: DataFrame, report_type: str) -> DataFrame:
    """Rows of a report without pseudo-headers; rows without a student id count."""
    return cells.agg(F.count_if(_is_data_row(cells, report_type)).alias("row_count"))


def json_kind(value: Column) -> Column:
    """Kind bit of a JSON value held as variant; null has no vote."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), 0)
        .when(kind == "BIGINT", BIGINT)
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), DOUBLE)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind == "STRING", VARCHAR)
        .otherwise(JSON)
    )


def json_type(kinds: Column) -> Column:
    """Column type for the JSON kinds seen: any mix but integer and float is JSON."""
    return (
        F.when(kinds == 0, "VARCHAR")
        .when(kinds == BIGINT, "BIGINT")
        .when(kinds.isin(DOUBLE, BIGINT | DOUBLE), "DOUBLE")
        .when(kinds == BOOLEAN, "BOOLEAN")
        .when(kinds == VARCHAR, "VARCHAR")
        .otherwise("JSON")
    )


def json_kinds(records: DataFrame, record: str = "record", by: Sequence[str] = ()) -> DataFrame:
    """``column, kinds`` for all fields of JSON object records, per group of ``by``.

    Kinds of parts OR-ed are the kinds of the whole.  Records that are no JSON object do not vote.
    """
    fields = F.try_variant_get(F.try_parse_json(F.col(record)), "$", "map<string,variant>")
    cells = records.select(*by, F.explode(fields).alias("column", "value"))
    return cells.groupBy(*by, "column").agg(F.bit_or(json_kind(F.col("value"))).alias("kinds"))


def infer_json_columns(records: DataFrame, record: str = "record", pinned: bool = True) -> DataFrame:
    """A4: ``column, type`` for all fields of JSON object records.

    With ``pinned`` the contract columns are always present with their fixed types.
    """
    seen = json_kinds(records, record).select("column", json_type(F.col("kinds")).alias("type"))
    if not pinned:
        return seen
    fixed = records.sparkSession.createDataFrame(sorted(PINNED.items()), "column string, type string")
    return seen.where(~F.col("column").isin(*PINNED)).unionByName(fixed)


# Column types as Spark names them.
SPARK_TYPES = {
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "VARCHAR": "string",
    "JSON": "string",
    "TIMESTAMP": "timestamp",
}


def spark_type(name: str) -> str:
    """Spark type that carries a column type; JSON stays text."""
    return SPARK_TYPES[name]


def common_type(types: set[str]) -> str:
    """Type a column takes when frames that declare it differently are united by name."""
    numbers = {"bigint", "double", "boolean"}
    if len(types) == 1:
        return next(iter(types))
    if types <= numbers:
        return "double" if "double" in types else "bigint"
    return "string"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
