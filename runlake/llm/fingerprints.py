"""Document fingerprints: bottom-k sketches of word shingle hashes, by DataFrame functions alone.

A sketch holds the ``k`` smallest 64-bit hashes of a text's distinct shingles, ascending.  Sketches of
parts merge to the sketch of the whole, and two of them estimate resemblance, containment and the
number of distinct shingles; up to ``k`` shingles the answers are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAPS, written

SHINGLE_WORDS, SKETCH_SIZE = 5, 128
HALF_RANGE = float(1 << 63)
QUANTILES, BUCKET_ROWS = 256, 2000


def sketch(text: Column, k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> Column:
    """Bottom-k sketch of a text, an array of longs.

    Null, empty and blank texts have no shingle and an empty sketch; a text of fewer words than a
    shingle is one shingle.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # The words are hashed once; a shingle hashes their hashes.
    some = lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(width)])
    )
    short = lambda h: F.transform(F.filter(F.array(h), lambda x: F.size(x) > 0), lambda x: F.xxhash64(x))
    hashes = F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= width, some(h)).otherwise(short(h)))
    return F.slice(F.sort_array(F.array_distinct(F.element_at(hashes, 1))), 1, k)


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_groups(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per group of many parts.

    Parts are first thinned to the ``k`` lowest hashes per group and task (the rank filter sits on the
    window), so a group of any size sends ``k`` rows a task.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("_hash")).distinct()
    lowest = Window.partitionBy(*keys).orderBy("_hash")
    kept = hashes.withColumn("_rank", F.row_number().over(lowest)).where(F.col("_rank") <= k)
    found = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))
    empty = sketches.select(*keys).distinct().join(found.select(*keys), keys, "left_anti")
    return found.unionByName(empty.withColumn(column, F.array().cast("array<bigint>")))


def distinct_shingles(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact while the sketch is not full."""
    # Share of the hash range below the largest hash kept.
    reached = (F.element_at(a, -1).cast("double") + HALF_RANGE) / (2 * HALF_RANGE)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reached)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold.  Two empty ones are alike."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    size = F.least(F.lit(k), F.size(a) + F.size(b) - F.size(F.array_intersect(a, b)))
    return F.when(size > 0, both / size).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of the first text's shingles that the second has; an empty text is contained in any."""
    together = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), together / distinct_shingles(a, k)))


def shown(a: Column) -> Column:
    """A sketch as text: hexadecimal hashes, ascending, with commas."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def _placed(docs: DataFrame, key: str, rows: int) -> DataFrame:
    """``docs`` with ordered buckets ``_q, _sub`` of about ``BUCKET_ROWS`` rows.

    Quantiles of the key cut the range, equal steps cut what lies between two of them, so neither a
    gap nor an outlier among the keys leaves a bucket with a large share of the rows.
    """
    probes = [i / QUANTILES for i in range(QUANTILES + 1)]
    bounds = docs.agg(F.percentile_approx(key, probes, 10_000).alias("b")).first()["b"] or [0]
    bounds = sorted(set(bounds))
    steps = max(1, rows // (BUCKET_ROWS * QUANTILES) + 1)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    # A null key comes before all others.
    q = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col(key))))
    low, high = F.try_element_at(cuts, F.col("_q")), F.coalesce(F.try_element_at(cuts, F.col("_q") + 1), F.col(key) + 1)
    inside = (F.col(key) - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1.0)) * steps
    return docs.withColumn("_q", q).withColumn("_sub", F.when(F.col("_q") > 0, F.floor(inside)).otherwise(0).cast("long"))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text, _next, _sentinel, _q, _sub``: every text beside that of the next key, the last beside the first.

    Texts move once, into ordered buckets; the first text of the next bucket comes along as a sentinel
    row at a bucket's end, to be dropped after the last use of the order (:func:`in_order`).  Rows of
    equal key are ordered by their text, null keys come first.
    """
    plain = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = plain.count()
    placed = _placed(plain, "_key", rows)
    heads = placed.groupBy("_q", "_sub").agg(F.min("_key").alias("_key"))
    order = Window.orderBy("_q", "_sub")  # a row per bucket, no text
    following = F.coalesce(F.lag(F.struct("_q", "_sub")).over(order), F.max(F.struct("_q", "_sub")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = written(heads.select("_key", following.alias("_before")), "heads")
    first = plain.join(heads.withColumnRenamed("_key", "_head"), F.col("_key").eqNullSafe(F.col("_head")))
    first = first.groupBy("_before").agg(F.min("_text").alias("_text"))
    sentinels = first.select(
        F.lit(None).cast("long").alias("_key"), "_text", F.col("_before._q").alias("_q"), F.col("_before._sub").alias("_sub"), F.lit(True).alias("_sentinel")
    )
    all_rows = placed.withColumn("_sentinel", F.lit(False)).unionByName(sentinels)
    return all_rows.withColumn("_next", F.lead("_text").over(in_order()))


def in_order():
    return Window.partitionBy("_q", "_sub").orderBy("_sentinel", F.col("_key").asc_nulls_first(), "_text")


def fingerprinted(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SKETCH_SIZE, width: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next text's are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many of
    the next document.  Null texts are empty, repeated rows are documents of their own, a null key
    stays null, an empty table gives no rows.  An only document is its own next one.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    found = with_next(docs, text, key).withColumn("n_chars", F.char_length("_text").cast("long"))
    found = found.withColumn("_sketch", sketch(F.col("_text"), k, width))
    found = found.withColumn("_next_sketch", F.lead("_sketch").over(in_order())).where("NOT _sentinel")
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half))
    found = found.withColumn("_edited", edited).withColumn("_edited_sketch", sketch(F.col("_edited"), k, width))
    return found.select(
        F.col("_key").alias(key), "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        shown(F.col("_sketch")).alias("fingerprint"), shown(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("n_shingles"),
    )
