"""Work across datasets: G3, G7."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import union_by_name


def union_datasets(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Union by name over datasets, each row with the alias of its ``dataset``."""
    return union_by_name([df.select(F.lit(alias).alias("dataset"), "*") for alias, df in frames.items()])


def compare_datasets(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two pulls of one store, by identity: ``only_a``, ``only_b``, ``changed`` or ``same``.

    ``keys`` must be unique on each side, as they are in a store.
    """
    left = a.select(*keys, F.struct(*values).alias("a"))
    right = b.select(*keys, F.struct(*values).alias("b"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values])
    status = (
        F.when(F.col("b").isNull(), "only_a")
        .when(F.col("a").isNull(), "only_b")
        .when(same, "same")
        .otherwise("changed")
    )
    return left.join(right, list(keys), "full_outer").withColumn("status", status)
