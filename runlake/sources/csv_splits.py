"""CSV records that span lines, read in splits: A1.

A file is read line by line in as many tasks as it has splits.  Whether a split begins inside a quoted cell
follows from the number of quotes before it: one count per split, added up per file.  Within a split
the running count says at which lines records start; lines before the first start belong to the
record that an earlier split began.  The running count shuffles lines once, by split; only records of
several lines are shuffled again, to be put together.
Line breaks within cells stay as they are, ``\\r\\n`` too; a reader of whole files may make them ``\\n``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_lines(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """``file, split, at, line, quotes``: the lines of text files in the order ``split, at``, and how many quotes each holds."""
    found = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    return found.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), quotes.alias("quotes"),
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """``file, split, at, record, closed`` of the lines of CSV files; place and text of each record, its line breaks kept.

    ``closed`` is false for a record whose last quote is missing at the end of the file.  Lines of
    nothing between records are records of no text.
    """
    in_file = Window.partitionBy("file").orderBy("split")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("_quotes"))
    opened = F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)).alias("_before")
    in_split = Window.partitionBy("file", "split").orderBy("at")
    before = F.col("_before") + F.coalesce(F.sum("quotes").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(splits.select("file", "split", opened), ["file", "split"]).withColumn("_start", F.when(before % 2 == 0, F.col("at")))
    placed = placed.withColumn("_own", F.max("_start").over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    # A split's last start is where the lines belong that open the next split inside a cell.
    last = placed.groupBy("file", "split").agg(F.max("_start").alias("_start"))
    begun = F.last(F.when(F.col("_start").isNotNull(), F.struct("split", F.col("_start").alias("at"))), ignorenulls=True).over(earlier)
    carried = last.select("file", "split", begun.alias("_begun"))
    own = F.struct("split", F.col("_own").alias("at"))
    owned = placed.join(carried, ["file", "split"]).withColumn("_record", F.when(F.col("_own").isNotNull(), own).otherwise(F.col("_begun")))
    ends = F.col("quotes") % 2 == 0
    whole = owned.where(F.col("_start").isNotNull() & ends)
    parts = owned.where(F.col("_start").isNull() | ~ends).groupBy("file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("_lines"), (F.sum("quotes") % 2 == 0).alias("closed")
    )
    joined = F.array_join(F.col("_lines.line"), "\n")
    return whole.select("file", "split", "at", F.col("line").alias("record"), F.lit(True).alias("closed")).unionByName(
        parts.select("file", "_record.split", "_record.at", joined.alias("record"), "closed")
    ).withColumn("record", F.regexp_replace("record", "\r$", ""))


def is_plain(record: Column, delim: str, quote: str) -> Column:
    """Whether quotes of a record stand only around whole cells or doubled within them, as counting them supposes."""
    q, d = (f"\\x{{{ord(c):x}}}" for c in (quote, delim))
    # Each quoted stretch becomes one quote, so what is left is the text outside and where stretches stand.
    outside = F.regexp_replace(record, f"{q}[^{q}]*{q}", quote)
    return ~(outside.rlike(f"[^{q}{d}]{q}") | outside.rlike(f"{q}[^{q}{d}]") | outside.rlike("\r"))


def split_cells(spark: SparkSession, path: str | list[str], names: Sequence[str], dialect: Mapping[str, str]) -> DataFrame | None:
    """All cells as text under ``names``, by position, without each file's header; None if the files cannot be read in splits.

    That is so if a quote stands inside a bare cell, or a cell is never closed, or quotes are escaped
    by another character: then only reading from the start tells where records end.
    """
    if dialect["escape"] != dialect["quote"] or any(len(dialect[k]) != 1 for k in ("delim", "quote")):
        return None
    records = csv_records(csv_lines(spark, path, dialect["quote"])).where("record <> ''")
    if records.where(~F.col("closed") | ~is_plain(F.col("record"), dialect["delim"], dialect["quote"])).head(1):
        return None
    place = F.struct("split", "at")
    headers = records.groupBy("file").agg(F.min(place).alias("_header"))
    rows = records.join(headers, "file").where(place != F.col("_header"))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": dialect["delim"], "quote": dialect["quote"], "escape": dialect["escape"], "multiLine": "true"}
    cells = rows.select(F.from_csv("record", schema, options).alias("_c"))
    return cells.select(*[F.col(f"_c.c{i}").alias(name) for i, name in enumerate(names)])
