"""Order-dependent columns for keys of any size.

A plain window sorts all rows of one key in one task.  Here the rows of a key are first cut
into ordered buckets (a day, a block of positions), each bucket is one window group, and
what a bucket needs from the buckets before it is carried over from a small per-bucket
summary.  The summary is pre-aggregated before its shuffle, the results are exactly those
of the plain window, and a key that owns a third of all rows spreads over its buckets.

How many rows a day of a key has is counted first.  Buckets of more than ``most_rows`` are cut
further, at splitters drawn from their own rows, so groups stay bounded where a key has all its
rows within a day, or a second.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir

DAY_SECONDS = 86_400
BLOCK_ROWS = 1_000_000
# Rows drawn for each part that a dense bucket is cut into.
DRAWS = 64


def time_bucket(ts: Column, seconds: int = DAY_SECONDS) -> Column:
    """Bucket number of an instant."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")


def position_bucket(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Bucket number of an integer position."""
    return F.floor(position / F.lit(rows)).cast("bigint")


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    lag: Mapping[str, str] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    most_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Add previous-row values, running sums and running maxima per key.

    ``bucket`` must never decrease along ``order``, and ``order`` must be total within a
    key.  Buckets of more than ``most_rows`` rows are cut further, which takes a count of rows
    first; None leaves them as they are.  ``lag`` maps a new column to the column whose previous value it takes; ``sums``
    and ``maxes`` map a new column to the expression to accumulate, current row included.
    """
    lag, sums, maxes = dict(lag or {}), dict(sums or {}), dict(maxes or {})
    base, names, parts = _grouped(df, keys, bucket, order, most_rows)
    group = [*names, *parts]
    within = Window.partitionBy(*group).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)

    local: dict[str, Column] = {}
    summary: list[Column] = []
    if lag:
        last = F.struct(*[F.col(source).alias(name) for name, source in lag.items()])
        local["_prev"] = F.lag(last).over(within)
        summary.append(F.max_by(last, F.struct(*order)).alias("_tail"))
    for name, value in sums.items():
        local[name] = F.sum(value).over(upto)
        summary.append(F.sum(value).alias(f"_of_{name}"))
    for name, value in maxes.items():
        local[name] = F.max(value).over(upto)
        summary.append(F.max(value).alias(f"_of_{name}"))
    rows = base.withColumns(local)

    chain, before = _chain(names, parts)
    carried = [F.col(c) for c in group]
    if lag:
        carried.append(F.lag("_tail").over(chain).alias("_carry"))
    carried += [F.sum(f"_of_{n}").over(before).alias(f"_before_{n}") for n in sums]
    carried += [F.max(f"_of_{n}").over(before).alias(f"_before_{n}") for n in maxes]
    heads = base.groupBy(*group).agg(*summary).select(*carried)
    joined = rows.join(heads, group, "inner")

    out = [F.col(c) for c in df.columns]
    for name in lag:
        out.append(
            F.when(F.col("_prev").isNotNull(), F.col("_prev")[name]).otherwise(F.col("_carry")[name]).alias(name)
        )
    out += [(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums]
    out += [F.greatest(n, f"_before_{n}").alias(n) for n in maxes]
    return joined.select(*out)


def session_columns(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, event: str, gap_seconds: int, bucket_seconds: int = DAY_SECONDS,
    most_rows: int | None = BLOCK_ROWS,
) -> DataFrame:
    """Add ``prev_event, gap_micros, new_session, session_no, step`` per key in one pass.

    A session starts at a key's first row and after each gap longer than ``gap_seconds``.
    Whether the first row of a bucket starts a session, how many sessions and rows came
    before it and where the session it continues began all follow from the bucket
    summaries.  The rows are shuffled once; the summaries come from a second, narrow read
    of key, time and event only.  ``most_rows`` is as in :func:`ordered_columns`.
    """
    limit = gap_seconds * 1_000_000
    base, names, parts = _grouped(df, keys, time_bucket(F.col(ts), bucket_seconds), [ts, tie], most_rows)
    group = [*names, *parts]
    base = base.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    within = Window.partitionBy(*group).orderBy(ts, tie)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.col(event).alias("event"), F.col("_at").alias("at"))
    one = F.lit(1).cast("bigint")
    rows = base.withColumns({"_prev": F.lag(here).over(within), "_n": F.row_number().over(within).cast("bigint")})
    rows = rows.withColumn("_new", F.coalesce(F.col("_at") - F.col("_prev.at") > limit, F.lit(False)))
    rows = rows.withColumns({
        "_news": F.sum(F.col("_new").cast("bigint")).over(upto),
        "_start": F.max(F.when(F.col("_new"), F.col("_n"))).over(upto),
    })

    chain, before = _chain(names, parts)
    heads = rows.groupBy(*group).agg(
        F.min("_at").alias("_first"), F.max_by(here, F.struct(ts, tie)).alias("_last"), F.max("_n").alias("_rows"),
        F.max("_news").alias("_news"), F.max("_start").alias("_start"),
    )
    heads = heads.withColumn("_carry", F.lag("_last").over(chain))
    heads = heads.withColumn("_opens", F.coalesce(F.col("_first") - F.col("_carry.at") > limit, F.lit(True)))
    heads = heads.withColumns({
        "_rows_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
        "_news_before": F.coalesce(F.sum(F.col("_news") + F.col("_opens").cast("bigint")).over(before), F.lit(0)),
    })
    start = F.col("_rows_before") + F.coalesce("_start", F.when(F.col("_opens"), one))
    heads = heads.withColumn("_start_before", F.max(start).over(before))
    heads = heads.select(*group, "_carry", "_opens", "_rows_before", "_news_before", "_start_before")
    joined = rows.join(heads, group, "inner")
    first = F.col("_n") == 1
    prev = F.when(first, F.col("_carry")).otherwise(F.col("_prev"))
    began = F.coalesce(
        F.col("_rows_before") + F.col("_start"), F.when(F.col("_opens"), F.col("_rows_before") + 1), F.col("_start_before")
    )
    return joined.select(
        *df.columns,
        prev["event"].alias("prev_event"),
        (F.col("_at") - prev["at"]).alias("gap_micros"),
        F.when(first, F.col("_opens")).otherwise(F.col("_new")).alias("new_session"),
        (F.col("_news_before") + F.col("_opens").cast("bigint") + F.col("_news")).alias("session_no"),
        (F.col("_rows_before") + F.col("_n") - began + 1).alias("step"),
    )


def _grouped(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], most_rows: int | None
) -> tuple[DataFrame, list[str], list[str]]:
    """The frame with never-NULL columns for key and bucket, and the names of both.

    Rows and summaries join by plain equality on the very columns the rows are already
    partitioned and sorted by, so the rows are not shuffled a second time; a NULL key is a
    key of its own.
    """
    fields = {f.name: f for f in df.schema.fields}
    added: dict[str, Column] = {}
    for i, k in enumerate(keys):
        field, value = fields[k], F.col(k)
        if field.nullable:
            added[f"_null{i}"] = value.isNull()
            if isinstance(field.dataType, T.NumericType):
                value = F.coalesce(value, F.lit(0).cast(field.dataType))
            else:
                value = F.coalesce(value.cast("string"), F.lit(""))
        added[f"_key{i}"] = value
    names = list(added)
    base = df.withColumns(added).withColumn("_bucket", F.coalesce(bucket, F.lit(-1)))
    splits = None if most_rows is None else _splitters(base, [*names, "_bucket"], order, most_rows)
    if splits is None:
        return base, names, ["_bucket"]
    base = base.join(splits, [*names, "_bucket"], "left").withColumn("_part", _place(F.col("_splits"), F.struct(*order)))
    return base.drop("_splits"), names, ["_bucket", "_part"]


def _splitters(base: DataFrame, group: Sequence[str], order: Sequence[str], most_rows: int) -> DataFrame | None:
    """``_splits`` for each group of more than ``most_rows`` rows: the order values that cut it into parts of about as many.

    Some ``DRAWS`` rows a part are drawn by a hash of their order values, so reruns cut alike; rows of
    equal order values stay together.  One task sorts the drawn rows of a group, a 15,000th of it at
    the usual size of parts.  Both tables are written, so their sizes are known when the rows meet them.
    """
    spark = base.sparkSession
    folder = work_dir(spark, "dense")
    base.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most_rows).write.parquet(f"{folder}/groups")
    dense = spark.read.parquet(f"{folder}/groups")
    if dense.isEmpty():
        return None
    one_in = max(1, most_rows // DRAWS)
    drawn = base.where(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0).select(*group, F.struct(*order).alias("_at"))
    drawn = drawn.join(dense.select(*group), list(group), "left_semi")
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_at")))
    cuts = drawn.where(F.col("_n") % max(1, most_rows // one_in) == 0)
    cuts.groupBy(*group).agg(F.sort_array(F.collect_list("_at")).alias("_splits")).write.parquet(f"{folder}/splits")
    return spark.read.parquet(f"{folder}/splits")


def _place(splits: Column, at: Column) -> Column:
    """How many of the sorted ``splits`` are not after ``at``, by halving; 0 without any."""

    def halve(found: Column, _: Column) -> Column:
        low, high = found["low"], found["high"]
        middle = F.shiftright(low + high, 1)
        open_ = low < high
        upper = open_ & (F.get(splits, middle) <= at)
        return F.struct(
            F.when(upper, middle + 1).otherwise(low).alias("low"), F.when(open_ & ~upper, middle).otherwise(high).alias("high")
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(splits) + 1)).cast("int"))
    whole = F.struct(F.lit(0).alias("low"), F.size(splits).alias("high"))
    return F.when(splits.isNull(), 0).otherwise(F.aggregate(steps, whole, halve)["low"])


def _chain(keys: Sequence[str], parts: Sequence[str]):
    """The buckets of a key in order, and all buckets before the current one."""
    chain = Window.partitionBy(*keys).orderBy(*parts)
    return chain, chain.rowsBetween(Window.unboundedPreceding, -1)
