"""Query results for other programs: A13, A14, H13."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_value
from ..session import work_dir

MAX_ROWS = 1000  # fixed value: default result cap


def json_friendly(df: DataFrame) -> DataFrame:
    """Every column in a form that survives JSON."""
    return df.select(*[json_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _as_text(df: DataFrame) -> DataFrame:
    """JSON-friendly columns as CSV cells: NULL empty, texts without quotes."""
    out = []
    for f in json_friendly(df).schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind == "variant":
            c = F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.cast("string").alias(f.name))
    return json_friendly(df).select(*out)


def write_result(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """A result as ``csv``, ``jsonl`` or ``json`` files, all written in parallel.

    The part files of ``json``, put together in name order, are one array.
    """
    if fmt == "csv":
        _as_text(df).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    elif fmt == "jsonl":
        json_friendly(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "json":
        _write_array(json_friendly(df), path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def _write_array(df: DataFrame, path: str) -> None:
    """One JSON array over many part files: opening, rows and closing in file order.

    The rows are numbered in a written table first, so that the second pass over them sees
    the same numbers even if executors are lost.
    """
    spark = df.sparkSession
    staged = work_dir(spark, "array")
    row = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).withColumn("n", F.monotonically_increasing_id()).write.parquet(staged)
    rows = spark.read.parquet(staged)
    first = rows.agg(F.min("n")).head()[0]
    separator = F.when(F.col("n") == F.lit(first), "").otherwise(",")
    body = rows.orderBy("n").select(F.concat(separator, "value").alias("value"))
    spark.createDataFrame([("[",)], "value string").coalesce(1).union(body).union(
        spark.createDataFrame([("]",)], "value string").coalesce(1)
    ).write.mode("overwrite").text(path)


def collect_capped(df: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], list[dict[str, Any]], bool, int]:
    """``columns, rows, truncated, row_count``: the first rows and the true count.

    Only ``max_rows`` rows reach the driver; the count is an aggregate of its own.
    """
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    head = json_friendly(df).limit(max_rows).select(text.alias("row")).collect()
    rows = [json.loads(r.row) for r in head]
    total = len(rows) if len(rows) < max_rows else df.count()
    return df.columns, rows, total > len(rows), total
