"""Stores in key-hash buckets: A15 with copy-on-write, A4 from statistics.

A store version is a list of bucket folders, each written by one merge and never changed::

    <version>/records/_bucket=B/    identity, stamps, record text
    <version>/columns/_bucket=B/    the same records as typed columns
    <version>/kinds/                ``_bucket, column, kinds``: which kinds of values a field has there

A merge writes the buckets it touches and names the others where they are.  The kinds of all buckets
OR-ed give the column map, so it follows from the records without reading them again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity_key, key_columns
from ..operators.inference import PINNED, json_kinds, json_type, spark_type

BUCKET = "_bucket"
# Type of a column all of whose values are null; it fits any other.
NONE = "NONE"


def bucket_of(record_type: str, buckets: int) -> Column:
    """The bucket of a record by the hash of its identity."""
    return F.pmod(F.xxhash64(identity_key(*key_columns(record_type))), F.lit(buckets)).cast("int")


def in_buckets(df: DataFrame, record_type: str, buckets: int, wanted: Sequence[int]) -> DataFrame:
    """The rows (with identity columns) whose bucket is one of ``wanted``."""
    if len(set(wanted)) == buckets:
        return df
    return df.where(bucket_of(record_type, buckets).isin(*wanted)) if wanted else df.where(F.lit(False))


def write_buckets(df: DataFrame, path: str, record_type: str, buckets: int) -> None:
    """Records by bucket, in identity order within each file.

    Rows are dealt by bucket once, without a sampling job or ranges; a bucket far larger than
    others becomes several files instead of one long task.
    """
    key = identity_key(*key_columns(record_type))
    dealt = df.withColumn(BUCKET, bucket_of(record_type, buckets)).hint("rebalance", BUCKET)
    dealt.sortWithinPartitions(BUCKET, key).write.partitionBy(BUCKET).parquet(path)


def write_kinds(records: DataFrame, path: str) -> None:
    """``_bucket, column, kinds`` of records just written."""
    json_kinds(records, by=[BUCKET]).write.parquet(path)


def column_kinds(spark: SparkSession, live: Mapping[int, str]) -> dict[str, tuple[str, bool]]:
    """Per column its type and whether all its values are null, from the kinds of the buckets' folders.

    ``live`` has the version folder of every bucket.  One row per field name reaches the driver.
    """
    found = {}
    if live:
        paths = sorted(set(live.values()))
        names = spark.createDataFrame(sorted((p, b) for b, p in live.items()), f"_path string, {BUCKET} int")
        kinds = None
        for p in paths:
            one = spark.read.schema(f"{BUCKET} int, column string, kinds int").parquet(f"{p}/kinds").withColumn("_path", F.lit(p))
            kinds = one if kinds is None else kinds.unionByName(one)
        seen = kinds.join(names, ["_path", BUCKET]).groupBy("column").agg(F.bit_or("kinds").alias("kinds"))
        rows = seen.select("column", json_type(F.col("kinds")).alias("type"), (F.col("kinds") == 0).alias("none")).collect()
        found = {r["column"]: (r["type"], r["none"]) for r in rows}
    return dict(sorted((found | {c: (t, False) for c, t in PINNED.items()}).items()))


def fitted(df: DataFrame, written: Mapping[str, str], target: Mapping[str, str], kept: Sequence[str]) -> DataFrame | None:
    """Typed columns that were written under one column map as they are under another.

    Absent and all-null columns are null, integers widen to floats.  None if a column needs the
    record text: it changed to or from JSON, or names differ in case only.
    """
    if written == target:
        return df
    if len({c.lower() for c in target}) < len(target) or len({c.lower() for c in written}) < len(written):
        return None
    columns = []
    for c, t in target.items():
        was = written.get(c, NONE)
        value = F.col(f"`{c}`")
        if c in kept or was == t:
            columns.append(value.alias(c))
        elif was == NONE or t == NONE:
            columns.append(F.lit(None).cast(spark_type("VARCHAR" if t == NONE else t)).alias(c))
        elif (was, t) == ("BIGINT", "DOUBLE"):
            columns.append(value.cast("double").alias(c))
        else:
            return None
    return df.select(*columns)
