"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source's documents below a hash threshold are taken once
more than the rest, so a mix is one number per source and applying it is a filter.  The threshold is
found without sorting: words are summed by source and hash bucket, the bucket in which the running
sum passes the budget is refined by the next bits of the hash, and all others are settled.  Budgets
are nested: a larger target takes a superset.

Only counts of at most ``2 ** LEVEL_BITS`` buckets per source and level are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, n_words, written

HASH_BITS = 60
LEVEL_BITS = 10
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def _source_key(source: Column) -> Column:
    """A source as a never-null key."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def _document_hash(doc_id: Column, text: Column, seed: str) -> Column:
    return hash60(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources from ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes;
    no target exceeds ``cap`` times its source, and the excess goes to the others by weight until
    none is above.  With sources ordered by size per weight that is one running sum: the capped ones
    are those whose cap lies below the share that the rest would get.  One row per source is ordered
    in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    weighed = weighed.withColumn("_ratio", F.col("_cap").cast("double") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    spread = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).alias("_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("_weights"),
    ).withColumn("_share", F.col("_left").cast("double") / F.col("_weights"))
    # The first source in this order that stays below its cap sets the share of all after it.
    free = F.min(F.when(F.col("_ratio") > F.col("_share"), F.struct("_ratio", "_share"))).over(everything)
    spread = spread.withColumn("_free", free)
    target = F.when(
        F.col("_free").isNull() | (F.col("_ratio") < F.col("_free._ratio")), F.col("_cap").cast("double")
    ).otherwise(F.least(F.col("weight") * F.col("_free._share"), F.col("_cap").cast("double")))
    return spread.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """``(sized, plan)``: the documents' sizes and hashes, and one row per source.

    ``plan`` has ``_source, source_size, target, repeats, threshold``: a document is taken
    ``repeats`` times and once more if its hash lies below ``threshold``.  A source's documents of
    equal hash (repeated ids) stand or fall together, by which side of the budget their middle lies
    on, so a source misses its target by half a document (or half such a group) at most.  Null texts
    have no words, a null id is replaced by the text, a null source is a source of its own.  Empty
    tables give no rows.
    """
    doc_hash = _document_hash(F.col(key), F.col(text), seed)
    sized = written(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_name"), _source_key(F.col(source)).alias("_source"),
        n_words(F.col(text)).alias("size"), doc_hash.alias("_hash"),
    ), "sized")
    sizes = sized.groupBy(F.col("_name").alias("source")).agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = source_targets(sizes, weights, cap).withColumn("repeats", F.least(whole, F.lit(cap)))
    state = written(state.select(
        _source_key(F.col("source")).alias("_source"), "source_size", "target", "repeats",
        (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"),
        # Bits of the threshold found so far, and the words of everything below them.
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(True).alias("open"),
    ), "mix-state")
    for level in range(HASH_BITS // LEVEL_BITS):
        state = written(_refined(sized, state, level), "mix-state")
    plan = state.select("_source", "source_size", "target", "repeats", F.col("prefix").alias("threshold"))
    return sized, plan


def _refined(sized: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """The state after one more level; at the last, ``prefix`` is the first hash that is not taken."""
    shift = HASH_BITS - LEVEL_BITS * (level + 1)
    last = shift == 0
    inside = sized.join(state.where("open").select("_source", "prefix"), "_source").where(
        F.shiftright("_hash", shift + LEVEL_BITS) == F.col("prefix")
    )
    bucket = F.shiftright("_hash", shift).alias("bucket")
    sums = inside.groupBy("_source", bucket).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(running)).join(state.select("_source", "budget", "below"), "_source")
    before = F.col("below") + F.col("upto") - F.col("words")
    over = F.col("below") + F.col("upto") > F.col("budget")
    first = F.min(F.when(over, F.struct("bucket", before.alias("before"), "words"))).alias("hit")
    found = sums.groupBy("_source").agg(first)
    moved = state.join(found, "_source", "left")
    hit, nothing = F.col("hit"), F.lit(1 << HASH_BITS).cast("long")
    prefix = hit["bucket"]
    if last:
        prefix = prefix + F.when(2 * hit["before"] + hit["words"] <= 2 * F.col("budget"), 1).otherwise(0)
    # Without a bucket that passes the budget, all documents below are taken.
    return moved.select(
        "_source", "source_size", "target", "repeats", "budget",
        F.when(~F.col("open"), F.col("prefix")).when(hit.isNull(), nothing).otherwise(prefix).alias("prefix"),
        F.when(F.col("open") & hit.isNotNull(), hit["before"]).otherwise(F.col("below")).alias("below"),
        (F.col("open") & hit.isNotNull()).alias("open"),
    )


def _times(cap: int) -> Column:
    return F.least(F.col("repeats") + F.when(F.col("_hash") < F.col("threshold"), 1).otherwise(0), F.lit(cap))


def mixed_sizes(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = "mix",
) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, times, taken`` (words taken, repeats counted)."""
    sized, plan = mixing_plan(docs, text, source, key, weights, cap, seed)
    return sized.join(plan, "_source").select(
        F.col("_key").alias(key), "size", "source_size", "target", _times(cap).alias("times"), (F.col("size") * _times(cap)).alias("taken")
    )


def mixed(
    docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
    weights: Sequence[int] = WEIGHTS, cap: int = MOST_REPEATS, seed: str = "mix",
) -> DataFrame:
    """The documents of the mix, all columns kept, each row as often as it is taken.

    The texts are not shuffled: the plan, a row per source, joins the scan.
    """
    _, plan = mixing_plan(docs, text, source, key, weights, cap, seed)
    tagged = docs.select(
        F.struct("*").alias("_doc"), _source_key(F.col(source)).alias("_source"), _document_hash(F.col(key), F.col(text), seed).alias("_hash")
    )
    taken = tagged.join(plan, "_source").where(_times(cap) > 0).select("_doc", F.explode(F.sequence(F.lit(1), _times(cap).cast("int"))))
    return taken.select("_doc.*")
