"""Near-duplicate documents by tensored MinHash banding, confirmed on full shingle sets.

Two small collections of ``SIDE`` sub-keys, each of ``ROWS`` minhashes, are computed for a document.
Every pair of a sub-key from each collection is a table key: ``SIDE ** 2`` tables for the minhashes of
``2 * SIDE`` keys.  Texts with equal shingle sets are one node from the start.

Candidates are confirmed in two steps, both linear in memory whatever a group's size:

1. A node meets the most central node of its tables, that which shares most sub-keys with others.
   That settles what lies around a common original.
2. Where a candidate group (all that hangs together by shared tables) still has several components,
   its nodes outside the largest one meet the whole group, in blocks of bounded size; a block pair
   reports only links that join components.

A link of similarity 0.8 shares no table with probability 0.04 % (see :func:`missed`), and step 2 looks at
the whole group, so a link is lost only if the two texts hang together by no chain of tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAPS, bit_filter, in_filter, mix64, shingle_hashes, texts, written
from .components import components

WIDTH, PERCENT = 5, 80
SIDE, ROWS = 12, 3
# Shingles of a block of a large group; a pair of blocks meets in one task.
FEW_SHINGLES, MANY_SHINGLES = 1 << 16, 1 << 18

_RANDOM = np.random.default_rng(2718281828)
FACTORS = _RANDOM.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _RANDOM.integers(0, 1 << 63, 2 * SIDE * ROWS, dtype=np.uint64)


def missed(similarity: float, side: int = SIDE, rows: int = ROWS) -> float:
    """Probability that two sets of a similarity share no table."""
    return 1 - (1 - (1 - similarity**rows) ** side) ** 2


def sub_keys(shingles: np.ndarray) -> np.ndarray:
    """``2 * SIDE`` sub-keys of a shingle set, first one collection, then the other."""
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * FACTORS + OFFSETS
        np.minimum(low, part.min(axis=0), out=low)
    keys = np.zeros(2 * SIDE, np.uint64)
    for column in low.reshape(2 * SIDE, ROWS).T:
        keys = mix64(keys + column)
    return keys


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes.lower() changes A-Z only


def _sketches(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """Per row: key, row id, size of the shingle set, digest of the set, sub-keys (none for an empty set)."""
    key_type = docs.schema[key].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in texts(batches, "text"):
            sizes, digests, keys = [], [], []
            for value in found:
                shingles = shingle_hashes(_words(value), width)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(sub_keys(shingles).view(np.int64) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["key", "row", "n", "digest", "subs"],
            )

    return _rows(docs, text, key).mapInArrow(sketch, f"key {key_type}, row bigint, n bigint, digest binary, subs array<bigint>")


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Key, row id and text; rows of equal key and text have the same id."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))


def _candidates(nodes: DataFrame) -> DataFrame:
    """``node, leader`` pairs that share a table, the leader being its most central node.

    A table needs both of its sub-keys shared, so sub-keys that only one node has are dropped before
    pairs of them are formed; what most documents have is dropped there.
    """
    subs = nodes.select("node", F.posexplode("subs").alias("slot", "sub"))
    shared = subs.groupBy("slot", "sub").agg(F.count("*").alias("n")).where("n > 1")
    left = subs.join(shared, ["slot", "sub"]).groupBy("node").agg(F.collect_list(F.struct("slot", "sub")).alias("subs"), F.sum("n").alias("central"))
    side = lambda test: F.filter("subs", test)
    first = left.select("node", "central", F.explode(side(lambda x: x["slot"] < SIDE)).alias("a"), side(lambda x: x["slot"] >= SIDE).alias("others"))
    tables = first.select("node", "central", "a", F.explode("others").alias("b"))
    tables = written(tables.select(F.xxhash64("a.slot", "a.sub", "b.slot", "b.sub").alias("table"), "node", "central"), "tables")
    leaders = tables.groupBy("table").agg(F.max(F.struct("central", "node")).alias("leader"), F.count("*").alias("n")).where("n > 1")
    pairs = tables.join(leaders.select("table", "leader"), "table").where(F.col("node") != F.col("leader.node"))
    return pairs.groupBy("node", F.col("leader.node").alias("leader")).agg(F.max("leader.central").alias("central"))


def _fetched(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``wanted`` (with ``node``, the id of a row) and the shingle set of that row's text.

    A bitmap of the wanted ids goes to the scan, so only their sets (and a few more) move, no texts.
    """
    spread = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "node"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(spread.value, batch.column(0).to_numpy())))
            sets = [shingle_hashes(_words(x), width).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = _rows(docs, text, key).select(F.col("row").alias("node"), "text")
    return rows.mapInArrow(shingle, "node bigint, shingles array<bigint>").join(wanted, "node").select(*wanted.columns, "shingles")


def _similar(shared: int | np.ndarray, n: int, m: int | np.ndarray, percent: int):
    return 100 * shared >= percent * (n + m - shared)


class Forest:
    """Union-find over the component labels of one block pair."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[x] = y
        return x != y


def block_links(block: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Links between the few and the many of a block pair that join different components.

    Shared shingles are counted through an inverted list of the few, a vector operation per node.
    """
    few, many = block[block.few], block[~block.few]
    sets = [np.asarray(s, np.int64) for s in few.shingles]
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets) if sets else np.empty(0, np.int64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    names, comps = few.node.tolist(), few.comp.tolist()
    forest, links = Forest(), []
    for node, comp, shingles in zip(many.node, many.comp, many.shingles, strict=True):
        shingles = np.asarray(shingles, np.int64)
        start, end = np.searchsorted(every, shingles, "left"), np.searchsorted(every, shingles, "right")
        runs = end - start
        total = int(runs.sum())
        if not total:
            continue
        # Positions start[i] .. end[i] of all runs, one after the other.
        at = np.arange(total) + np.repeat(start - np.concatenate(([0], np.cumsum(runs)[:-1])), runs)
        shared = np.bincount(owner[at], minlength=len(sets))
        for i in np.flatnonzero(_similar(shared, len(shingles), sizes, percent)).tolist():
            if names[i] != node and forest.join(comps[i], comp):
                links.append((names[i], node))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def _settled(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """All links of groups that the leaders left in several components."""
    placed = sets
    if not links.isEmpty():
        placed = sets.join(components(links), "node", "left")
        placed = placed.withColumn("comp", F.coalesce("root", "node")).drop("root")
    else:
        placed = sets.withColumn("comp", F.col("node"))
    narrow = written(placed.select("node", "group", "comp", F.size("shingles").cast("long").alias("n")), "placed")
    sized = narrow.groupBy("group", "comp").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"))
    groups = sized.groupBy("group").agg(
        F.max(F.struct("nodes", "comp")).alias("largest"), F.sum("total").alias("total"), F.count("*").alias("comps"), F.sum("nodes").alias("nodes"),
    # A group of two was decided by its leader.
    ).where("comps > 1 AND nodes > 2")
    outside = sized.join(groups.select("group", "largest"), "group").where(F.col("comp") != F.col("largest.comp"))
    few_total = outside.groupBy("group").agg(F.sum("total").alias("few_total"))
    groups = written(groups.join(few_total, "group").select(
        "group", F.col("largest.comp").alias("main"),
        F.ceil(F.col("few_total") / FEW_SHINGLES).cast("int").alias("few_blocks"), F.ceil(F.col("total") / MANY_SHINGLES).cast("int").alias("many_blocks"),
    ), "groups")
    open_rows = narrow.join(groups, "group").select("node", "group", "comp", (F.col("comp") != F.col("main")).alias("outside"), "few_blocks", "many_blocks")
    rows = open_rows.join(sets.select("node", "shingles"), "node")
    block = lambda blocks, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks).cast("long") - 1))
    columns = ["group", "fb", "mb", "few", "node", "comp", "shingles"]
    few = rows.where("outside").withColumns({"fb": block("few_blocks", 1), "few": F.lit(True)}).withColumn("mb", every("many_blocks"))
    many = rows.withColumns({"mb": block("many_blocks", 2), "few": F.lit(False)}).withColumn("fb", every("few_blocks"))
    meet = few.select(*columns).union(many.select(*columns))
    return meet.groupBy("group", "fb", "mb").applyInPandas(lambda b: block_links(b, percent), "u bigint, v bigint")


def resolved(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``key, row, n, component``; ``component`` is a class id, null for rows without shingles."""
    rows = written(_sketches(docs, text, key, width), "sketches")
    nodes = written(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.first("subs").alias("subs")), "nodes")
    pairs = written(_candidates(nodes.select("node", "subs")), "pairs")
    classes = nodes.select("digest", F.col("node").alias("component"))
    if not pairs.isEmpty():
        groups = components(pairs.select(F.col("node").alias("u"), F.col("leader").alias("v"))).withColumnRenamed("root", "group")
        best = pairs.groupBy("node").agg(F.max(F.struct("central", "leader")).alias("best")).select("node", "best.leader")
        wanted = written(groups.join(best, "node", "left"), "wanted")
        fetched = _fetched(docs, wanted, text, key, width)
        sets = written(fetched.dropDuplicates(["node"]) if _repeats(rows) else fetched, "sets")
        links = written(_leader_links(sets, percent), "links")
        links = written(links.union(_settled(sets.drop("leader"), links, percent)), "links")
        if not links.isEmpty():
            classes = nodes.select("digest", "node").join(components(links), "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    alone = rows.where("n = 0").select("key", "row", "n", F.lit(None).cast("bigint").alias("component"))
    return rows.where("n > 0").join(classes, "digest").select("key", "row", "n", "component").union(alone)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``key, n_shingles, component_id, kept``; ``component_id`` is the smallest key reachable by links.

    Texts link if ``100 * shared >= percent * union`` of their shingle sets.  Null, empty and blank
    texts have an empty set, link with nothing and are components of their own.  Rows that repeat a
    key are documents like any other and all of them are kept if the key is the smallest; null keys
    count only where a component has no other, and then every row is kept.  An empty table gives no rows.
    """
    found = written(resolved(docs, text, key, width, percent), "resolved")
    lowest = found.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("low"))
    low = F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("low"))
    return found.join(lowest, "component", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), low.alias("component_id"), F.col("key").eqNullSafe(low).alias("kept")
    )


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of the smallest key, all columns; texts without shingles all stay.

    What goes is a list of row ids.  The texts move only if that is too long to broadcast, or if rows
    repeat both key and text, of which one stays.
    """
    found = written(resolved(docs, text, key, width, percent), "resolved")
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first)
    gone = written(found.join(kept, "component").where("row <> first.row").select(F.col("row").alias("_row")).distinct(), "gone")
    marked = docs.select(F.struct("*").alias("_doc"), F.xxhash64(F.col(key), F.col(text)).alias("_row")).join(gone, "_row", "left_anti")
    if _repeats(found.where("component IS NOT NULL")):
        has_words = F.length(F.regexp_replace(F.coalesce(F.col(f"_doc.`{text}`"), F.lit("")), GAPS, "")) > 0
        marked = marked.where(has_words).dropDuplicates(["_row"]).union(marked.where(~has_words))
    return marked.select("_doc.*")


def _repeats(rows: DataFrame) -> bool:
    """Whether some row id occurs twice: only then may a fetched node have several rows."""
    return not rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _leader_links(sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between nodes and their leaders.  A leader with many nodes is split by Spark's skew join."""
    leaders = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("theirs"))
    leaders = leaders.join(sets.select("leader").where("leader IS NOT NULL").distinct(), "leader", "left_semi")
    met = sets.where("leader IS NOT NULL").join(leaders, "leader")
    shared = F.size(F.array_intersect("shingles", "theirs")).cast("long")
    similar = 100 * shared >= percent * (F.size("shingles") + F.size("theirs") - shared)
    return met.where(similar).select(F.col("node").alias("u"), F.col("leader").alias("v"))
