"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``u, v`` edges; the root is one node of the component.

    Each round points every node at its smallest neighbour, follows the pointers, and contracts the
    edges to what joins different roots.  A star is done after two rounds, a path of ``n`` nodes after
    about ``log n``.  Every round is a written table; nothing but a row count reaches the driver.
    """
    edges = written(_ordered(edges.select("u", "v")), "edges")
    mapping = None
    while True:
        ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        parents = written(lowest.select("node", F.least("node", "low").alias("root")), "parents")
        for _ in range(JUMPS):
            parents = written(_followed(parents, parents), "parents")
        mapping = parents if mapping is None else written(_followed(mapping, parents), "mapping")
        by_u = edges.join(parents.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u")
        by_both = by_u.join(parents.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
        edges = written(_ordered(by_both.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "edges")
        if edges.isEmpty():
            return mapping


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _followed(pointers: DataFrame, parents: DataFrame) -> DataFrame:
    onward = parents.select(F.col("node").alias("root"), F.col("root").alias("_next"))
    return pointers.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
