"""Record files: A3, A5, A6, A8, A12, A15."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity_key, key_columns
from ..operators.inference import spark_type

MEMBERSHIP_SCHEMA = (
    "source_key string, remote_endpoint string, question_id string, history_id string, type string, run_id bigint"
)


def read_record_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """NDJSON lines as ``record`` text with their ``_position``."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return record_lines(lines)


def record_lines(lines: DataFrame, of_file: Mapping[str, Column] | None = None) -> DataFrame:
    """Lines (``value, file_path, file_block_start``) as ``record`` and ``_position``, and columns that follow from ``file_path``.

    Positions compare like places in the files: by file, by split, then by line.  Files are ordered
    by name with runs of digits as numbers, so page 10 comes after page 2.  What follows from the file is computed once
    a file, not a line: the lines are scanned for their paths, and the few paths go back to them.
    """
    parts = F.regexp_extract_all("_path", F.lit(r"(\d+|\D+)"))
    natural = F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d{1,19}$"), F.lpad(x, 20, "0")).otherwise(x)), "")
    files = lines.select(F.col("file_path").alias("_path")).distinct().withColumn("_file", natural)
    files = files.select("*", *[c.alias(name) for name, c in (of_file or {}).items()])
    numbered = lines.withColumn("_line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    found = numbered.join(F.broadcast(files), numbered["file_path"].eqNullSafe(files["_path"]), "left")
    position = F.struct(F.col("_file").alias("file"), F.col("file_block_start").alias("block"), F.col("_line").alias("line"))
    return found.select(F.col("value").alias("record"), position.alias("_position"), *(of_file or {}))


def with_identity(records: DataFrame, record_type: str, record: str = "record") -> DataFrame:
    """Identity columns read from record text; absent is empty, anything but text an error."""
    keys = key_columns(record_type)
    # One step per parse; that JSON is an object shows in its first character, without a look at all its fields.
    step = records.withColumn("_parsed", F.try_parse_json(F.col(record)))
    step = step.withColumns({f"_v_{k}": F.try_variant_get("_parsed", f"$.{k}", "variant") for k in keys})
    is_object = F.col("_parsed").isNotNull() & F.ltrim(F.col(record), F.lit(" \t\r\n")).startswith("{")
    broken = F.raise_error(F.concat(F.lit("record is no JSON object: "), F.substring(F.col(record), 1, 200)))

    def field(name: str) -> Column:
        value = F.col(f"_v_{name}")
        kind = F.schema_of_variant(value)
        return (
            F.when(~is_object, broken)
            .when(value.isNull() | (kind == "VOID"), F.lit(""))
            .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
            .otherwise(F.raise_error(F.concat(F.lit(f"identity field {name} is not text: "), F.to_json(value))))
        )

    return step.withColumns({k: field(k) for k in keys}).drop("_parsed", *[f"_v_{k}" for k in keys])


def stamp(records: DataFrame, fetched_at: Column, run_id: int) -> DataFrame:
    """Records with ``_fetched_at`` (second precision) and ``_run_id``."""
    return records.withColumns(
        {"_fetched_at": F.date_trunc("second", fetched_at.cast("timestamp")), "_run_id": F.lit(run_id).cast("bigint")}
    )


def append_records(records: DataFrame, path: str, fetched_at: Column, run_id: int, batch: str) -> None:
    """Stamp records and add them to a run's segment as one batch.

    A batch owns its folder and is written whole, so delivering it again changes nothing.
    Batch names order the batches.
    """
    stamped = stamp(records, fetched_at, run_id).withColumn("_batch", F.lit(batch))
    stamped.write.mode("overwrite").parquet(f"{path}/run_id={run_id}/batch={batch}")


def append_batches(records: DataFrame, path: str, fetched_at: Column, batch: str) -> None:
    """A8 for many runs at once: rows with ``run_id`` and ``fetch``, each to the segment of its run's fetch.

    Delivered again, the batch replaces the folders of its own name and nothing else.
    """
    stamped = records.withColumns({
        "_fetched_at": F.date_trunc("second", fetched_at.cast("timestamp")), "_run_id": F.col("run_id"), "_batch": F.lit(batch), "batch": F.lit(batch),
    })
    writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("fetch", "run_id", "batch").parquet(path)


def read_batches(spark: SparkSession, path: str, batches: Mapping[tuple[int, str], Sequence[str]], record_type: str) -> DataFrame:
    """The stamped records of the named batches of ``(run, fetch)``; without any, no rows."""
    folders = [f"{path}/fetch={fetch}/run_id={run}/batch={b}" for (run, fetch), own in batches.items() for b in own]
    if folders:
        rows = spark.read.parquet(*folders)
    else:
        keys = ", ".join(f"{k} string" for k in key_columns(record_type))
        position = "struct<file:string,block:bigint,line:bigint>"
        rows = spark.createDataFrame([], f"{keys}, record string, _position {position}, _fetched_at timestamp, _run_id bigint, _batch string")
    return rows.withColumn("_position", F.struct("_batch", "_position")).drop("_batch")


def read_segments(spark: SparkSession, path: str, runs: Sequence[int]) -> DataFrame:
    """The stamped records of the given runs; the batch comes first in ``_position``."""
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/run_id={r}" for r in runs])
    return rows.withColumn("_position", F.struct("_batch", "_position")).drop("run_id", "batch", "_batch")


def type_records(
    records: DataFrame, columns: Mapping[str, str], record: str = "record", keep: Sequence[str] = ()
) -> DataFrame:
    """A3: record text as typed columns by column map; absent fields are NULL.

    JSON columns go through variants, so a quoted scalar keeps its quotes and a JSON null
    becomes NULL.  The column map is the schema; nothing is inferred at read time.
    """
    fields = {c: t for c, t in columns.items() if c not in keep}
    taken = {c.lower() for c in keep}
    alone = {c: t for c, t in fields.items() if sum(o.lower() == c.lower() for o in fields) == 1 and c.lower() not in taken}
    schema = T.StructType(
        [T.StructField(c, T.VariantType() if t == "JSON" else T._parse_datatype_string(spark_type(t))) for c, t in alone.items()]
    )
    # Column names ignore case, JSON fields do not: fields that differ only in case are
    # read by path, and each after the first gets a numbered column.
    parsed = records.select(
        *keep, F.from_json(F.col(record), schema).alias("_r"),
        *([F.try_parse_json(record).alias("_v")] if len(alone) < len(fields) else []),
    )
    out = []
    for c, t in fields.items():
        if c in alone:
            value, name = F.col("_r").getField(c), c
        else:
            value = F.try_variant_get("_v", f"$['{c}']", "variant" if t == "JSON" else spark_type(t))
            name, n = c, 2
            while name.lower() in taken:
                name, n = f"{c}__{n}", n + 1
        taken.add(name.lower())
        out.append((F.when(~F.is_variant_null(value), F.to_json(value)) if t == "JSON" else value).alias(name))
    return parsed.select(*keep, *out)


def typed_empty(spark: SparkSession, columns: Mapping[str, str]) -> DataFrame:
    """No rows, full schema, for an input that is absent or broken."""
    ddl = ", ".join(f"`{c}` {spark_type(t)}" for c, t in columns.items())
    return spark.createDataFrame([], ddl)


def write_store(df: DataFrame, path: str, record_type: str) -> None:
    """Records in identity order as a new store version.

    Range partitioning on the key gives files with narrow key ranges, so later lookups and
    merges skip files by their statistics; a key is unique here, so ranges are even.
    """
    key = identity_key(*key_columns(record_type))
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """A store version; with ``columns`` an NDJSON store is typed by its column map."""
    if columns is None:
        return spark.read.parquet(path)
    return type_records(read_record_lines(spark, path), columns)


def write_membership(membership: DataFrame, path: str) -> None:
    """One JSON object per identity, a folder per type and run; no history id if empty."""
    rows = membership.withColumn("history_id", F.nullif("history_id", F.lit("")))
    rows.select("source_key", "remote_endpoint", "question_id", "history_id", "type", "run_id").write.mode(
        "overwrite"
    ).partitionBy("type", "run_id").json(path)


def read_membership(spark: SparkSession, path: str | list[str], base: str | None = None) -> DataFrame:
    """The identity tuples of all runs; type and run prune folders."""
    reader = spark.read.schema(MEMBERSHIP_SCHEMA)
    if base:
        reader = reader.option("basePath", base)
    return reader.json(path).select("type", "run_id", "source_key", "remote_endpoint", "question_id", "history_id")
