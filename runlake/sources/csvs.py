"""Report CSV files: A1 and the text cells A2 infers from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.inference import spark_type
from .csv_splits import split_cells

# The RFC4180 dialect of report files.
DIALECT = {"delim": ",", "quote": '"', "escape": '"'}


def _reader(spark: SparkSession, dialect: Mapping[str, str], multiline: bool):
    return (
        spark.read.option("header", True)
        .option("sep", dialect["delim"]).option("quote", dialect["quote"]).option("escape", dialect["escape"])
        .option("multiLine", multiline)
    )


def has_multiline_cells(spark: SparkSession, path: str | list[str], quote: str = '"') -> bool:
    """Whether any cell of a CSV holds a line break.

    A record that spans lines leaves an odd number of quotes on some line.  This scan works
    line by line in parallel; when it finds none, the CSV itself can be read in splits too.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).head(1))


def read_cells(spark: SparkSession, path: str, dialect: Mapping[str, str] = DIALECT, multiline: bool | None = None) -> DataFrame:
    """All cells of a CSV as text, named by its header.

    A CSV with line breaks in cells is read in splits too, unless its quotes do not tell where
    records end (see :mod:`.csv_splits`); then a file is one task.
    """
    if multiline is None:
        multiline = has_multiline_cells(spark, path, dialect["quote"])
    whole = _reader(spark, dialect, multiline).csv(path)
    found = split_cells(spark, path, whole.columns, dialect) if multiline else None
    return whole if found is None else found


def failed_casts(
    spark: SparkSession, path: str, columns: Mapping[str, str], order: Sequence[str], dialect: Mapping[str, str] = DIALECT,
    multiline: bool | None = None,
) -> DataFrame:
    """``column, type, failed``: cells with text that the recorded type cannot hold, for columns that have any.

    :func:`scan_report_csv` gives NULL for these; this says how many there are.
    """
    cells = _cells(spark, path, columns, order, dialect, multiline)
    failed = [
        F.struct(F.lit(c).alias("column"), F.lit(columns[c]).alias("type"), F.count_if(F.nullif(F.col(f"`{c}`"), F.lit("")).isNotNull() & _typed(F.col(f"`{c}`"), columns[c]).isNull()).alias("failed"))
        for c in cells.columns
    ]
    return cells.agg(F.array(*failed).alias("_f")).select(F.inline("_f")).where("failed > 0")


def _typed(cell: Column, name: str) -> Column:
    value = F.nullif(cell, F.lit(""))
    target = spark_type(name)
    return value if target == "string" else value.try_cast(target)


def scan_report_csv(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str],
    order: Sequence[str],
    run_id: int,
    dialect: Mapping[str, str] = DIALECT,
    multiline: bool | None = None,
) -> DataFrame:
    """A1: one run's CSV with recorded types, matched **by position**, plus ``run_id``.

    ``order`` is the recorded file order; columns missing from it follow sorted by name.
    Nothing is inferred at read time.
    """
    cells = _cells(spark, path, columns, order, dialect, multiline)
    return cells.select(
        F.lit(run_id).cast("bigint").alias("run_id"), *[_typed(F.col(f"`{c}`"), columns[c]).alias(c) for c in cells.columns]
    )


def _cells(
    spark: SparkSession, path: str, columns: Mapping[str, str], order: Sequence[str], dialect: Mapping[str, str], multiline: bool | None
) -> DataFrame:
    """All cells as text under the recorded names, by position."""
    names = list(dict.fromkeys([c for c in order if c in columns])) + sorted(set(columns) - set(order))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    if multiline is None:
        multiline = has_multiline_cells(spark, path, dialect["quote"])
    found = split_cells(spark, path, names, dialect) if multiline else None
    return _reader(spark, dialect, multiline).schema(schema).csv(path) if found is None else found
