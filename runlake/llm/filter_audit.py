"""Audit of how filters interact, kept by incremental retraction over a stream of files.

Five filters fail a document: A few words, B few distinct words, C many capitals, D a symbol, E the same
text as a document of smaller id.  A to D depend on the text alone, E on all documents seen so far, so
the files are processed as available-now micro-batches with a keyed state: for every text its smallest
id and who holds it.  A document that arrives with a larger id counts as a copy; one with a smaller id takes
over, and the mask under which the earlier holder was counted is taken back from its part's counters and
counted again as a copy.  Counters are sums of such changes by part, mask and labels, so what the
batches say is independent of the order of files and rows.

Texts are keyed by a 128-bit digest; a state key holds the holders of about :data:`TEXTS_PER_KEY` digests as
an Arrow table, so state is updated a key at a time and not a text at a time.  State lies in RocksDB with
checkpoints in the shared folder; a batch that is run again writes the same counters to the same place.
Before its shuffle a task keeps, for each text, only its own smallest id: what it knows to be copies is added
up by part and mask.  So a text that a third of all documents have is one row a task.

Null ids are larger than all others and equal each other; null texts are empty, a null part is the empty string.
Documents of equal id and text are no copies of each other.  A document is labelled if any of its label
rows says so; labels without an id label nothing.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_dir
from ..sources.storage import Storage
from .common import texts

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The files are dealt into about so many micro-batches.
BATCHES = 4
TEXTS_PER_KEY = 4096
# Copies that a task has added up carry no text; so many keys pass them on.
COUNT_KEYS = 64
# Rows a task adds up before it passes them on.
HELD_ROWS = 100_000

# State is kept on disk; only what changed is written to the checkpoint, and no space is reserved ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# GOOD and TOXIC follow the mask's bits in ``bits``.
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
HELD = ["digest", "no_id", "id", "part", "bits", "n"]


def failed(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    data = (text or "").encode()
    words = data.split()
    few = len(words) < FEW_WORDS
    same = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    loud = 100 * capitals > UPPER_PERCENT * len(text or "")
    symbol = len(data.translate(None, SYMBOLS)) < len(data)
    return few | same << 1 | loud << 2 | symbol << 3


def _narrow(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """``id, no_id, part, digest, bits``: what the audit needs of a document."""
    key_type = docs.schema[key].dataType.simpleString()

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in texts(batches, "text"):
            digests = [hashlib.blake2b((x or "").encode(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(map(failed, found), pa.int32())],
                names=["id", "no_id", "part", "digest", "bits"],
            )

    ready = docs.select(
        F.coalesce(F.col(key), F.lit(0).cast(key_type)).alias("id"), F.col(key).isNull().alias("no_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"), F.col(text).alias("text"),
    )
    return ready.mapInArrow(narrow, f"id {key_type}, no_id boolean, part string, digest binary, bits int")


def _labelled(rows: DataFrame, labels: DataFrame, key: str, quality: str, toxic: str) -> DataFrame:
    """The rows with the bits of their labels.  A row without an id meets no label, and is spread by its digest."""
    good, bad = F.max(F.col(quality) == 1), F.max(F.col(toxic) == 1)
    flag = lambda x, bit: F.when(x, bit).otherwise(0)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((flag(good, GOOD) + flag(bad, TOXIC)).alias("label"))
    known = known.where("label > 0").withColumn("spread", F.lit(b""))
    rows = rows.withColumn("spread", F.when(F.col("no_id"), F.col("digest")).otherwise(F.lit(b"")))
    joined = rows.join(known, ["id", "spread"], "left")
    return joined.select("id", "no_id", "part", "digest", (F.col("bits") + F.coalesce("label", F.lit(0))).alias("bits"))


def _held_first(rows: pd.DataFrame) -> pd.Series:
    """Which rows have the smallest id of their text."""
    ranked = rows.sort_values(["digest", "no_id", "id"], kind="stable")
    first = ranked.groupby("digest", sort=False)[["no_id", "id"]].transform("first")
    return ((first["no_id"] == ranked["no_id"]) & (first["id"] == ranked["id"])).reindex(rows.index)


def _added(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    return rows.groupby(by, sort=False, as_index=False)["n"].sum()


def _combined(rows: DataFrame, keys: int, key_type: str) -> DataFrame:
    """Per task and text the holders of its smallest id; all others added up as copies, without a text."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        held: list[pd.DataFrame] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every = pd.concat(held, ignore_index=True)
            first = _held_first(every)
            own = _added(every[first], HELD[:-1])
            slots = [int.from_bytes(d[:8], "little") % keys for d in own["digest"]]
            yield pa.RecordBatch.from_pandas(own.assign(slot=slots)[["slot", *HELD]], schema, preserve_index=False)
            rest = every[~first].copy()
            if len(rest):
                rest["bits"] |= COPY
                copies = _added(rest, ["part", "bits"])
                slots = [-1 - int.from_bytes(hashlib.blake2b(f"{p}:{b}".encode(), digest_size=8).digest()) % COUNT_KEYS for p, b in zip(copies["part"], copies["bits"], strict=True)]
                copies = copies.assign(slot=slots, digest=b"", no_id=True, id=rest["id"].iloc[0])
                yield pa.RecordBatch.from_pandas(copies[["slot", *HELD]], schema, preserve_index=False)

        for batch in batches:
            if schema is None:
                own = {f.name: f.type for f in batch.schema}
                schema = pa.schema([("slot", pa.int64()), *((c, own.get(c, pa.int64())) for c in HELD)])
            if batch.num_rows:
                held.append(batch.to_pandas().assign(n=1))
                size += batch.num_rows
            if size >= HELD_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return rows.mapInArrow(combine, f"slot bigint, digest binary, no_id boolean, id {key_type}, part string, bits int, n bigint")


def retracted(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``(held, changes)`` after new rows: the holders of the smallest ids, and ``part, bits, n`` to add to the counters.

    A new holder counts by its own mask, any other new row as a copy; an earlier holder that lost its place is
    taken back under its mask and counted as a copy.
    """
    every = pd.concat([held.assign(_old=True), new.assign(_old=False)], ignore_index=True)
    first = _held_first(every)
    old = every["_old"]
    arrived, passed, lost = every[~old & first], every[~old & ~first], every[old & ~first]
    copy = lambda rows: rows.assign(bits=rows["bits"] | COPY)
    changes = pd.concat([arrived, copy(passed), lost.assign(n=-lost["n"]), copy(lost)])
    return _added(every[first], HELD[:-1]), _added(changes, ["part", "bits"])


def _tracked(rows: DataFrame, id_type: T.DataType) -> DataFrame:
    """The changes of ``part, bits, n`` that the rows of a batch make, by the state of their texts."""
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[id_type.simpleString()]
    schema = pa.schema([("digest", pa.binary()), ("no_id", pa.bool_()), ("id", arrow), ("part", pa.string()), ("bits", pa.int32()), ("n", pa.int64())])

    def track(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(frames), ignore_index=True)
        if key[0] < 0:
            yield _added(new, ["part", "bits"])
            return
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else schema.empty_table()
        kept, changes = retracted(held.to_pandas(), new[HELD])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_table(pa.Table.from_pandas(kept[HELD], schema, preserve_index=False))
        state.update((sink.getvalue().to_pybytes(),))
        yield changes

    return rows.groupBy("slot").applyInPandasWithState(track, "part string, bits int, n bigint", "held binary", "update", "NoTimeout")


def _either(path: str) -> str:
    """The path as a pattern that matches just it: a stream takes a pattern for a single file as well as for a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _state_keys(spark: SparkSession, folder: str, docs: DataFrame) -> int:
    """How many state keys the texts are dealt to: decided by the first call with a folder, as state is kept by key."""
    storage, path = Storage(spark, folder), f"{folder}/state-keys"
    if not storage.exists(path):
        storage.create(path, str(max(1, math.ceil(docs.count() / TEXTS_PER_KEY))))
    return int(storage.read(path))


def counters(
    spark: SparkSession, path: str, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source",
    quality: str = "quality", toxic: str = "toxic", folder: str | None = None, batches: int = BATCHES,
) -> DataFrame:
    """``part, bits, n``: documents by part, failed filters and labels, of the parquet files in ``path``.

    ``folder`` holds the stream's checkpoint and the counters of each batch.  Called again with the same
    folder, it goes on where it stopped and takes in files that came since.
    """
    docs = spark.read.parquet(path)
    id_type = docs.schema[key].dataType
    folder = folder or work_dir(spark, "filter-audit")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(1, math.ceil(len(docs.inputFiles()) / batches))).parquet(_either(path))
    keys = _state_keys(spark, folder, docs)
    rows = _labelled(_narrow(stream, text, key, part), labels, key, quality, toxic)
    changes = _tracked(_combined(rows, keys, id_type.simpleString()), id_type)

    def add(batch: DataFrame, number: int) -> None:
        added = batch.groupBy("part", "bits").agg(F.sum("n").alias("n"))
        added.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        query = changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    schema = "part string, bits int, n bigint, batch int"
    if docs.isEmpty():
        return spark.createDataFrame([], schema).drop("batch")
    return spark.read.schema(schema).parquet(f"{folder}/counters").groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step, what the step's filter does, from ``part, bits, n``.

    What a filter removes depends only on which filters ran before it, so the sums are over filters and sets of
    earlier ones; orders are looked up in them.  All tables but ``counts`` are fixed and small.
    """
    spark, every = counts.sparkSession, range(len(filters))
    bit = {f: 1 << k for k, f in enumerate(filters)}
    sets = [(1 << k, s) for k in every for s in range(1 << len(filters)) if not s >> k & 1]
    steps = [("".join(order), n + 1, bit[f], sum(bit[g] for g in order[:n])) for order in itertools.permutations(filters) for n, f in enumerate(order)]
    masks = spark.createDataFrame([(m, f, s) for m in range(1 << len(filters)) for f, s in sets], "mask int, filter int, earlier int")
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter int, earlier int")
    weights = orders.groupBy("filter", "earlier").agg(F.count("*").alias("times"))

    low = (1 << len(filters)) - 1
    small = counts.groupBy("part", F.col("bits").bitwiseAND(low).alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("bits").bitwiseAND(GOOD) > 0, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("bits").bitwiseAND(TOXIC) > 0, F.col("n")).otherwise(0)).alias("toxic"),
    )
    fails = F.col("mask").bitwiseAND(F.col("filter")) > 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda test, what="n": F.sum(F.when(test, F.col(what)).otherwise(0)).cast("long")
    sums = small.join(masks, "mask").groupBy("part", "filter", "earlier").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("filter")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = sums.join(weights, ["filter", "earlier"]).groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("times")).alias("shapley"))
    return sums.join(shapley, ["part", "filter"]).join(orders, ["filter", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audited(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """:func:`interactions` of the documents in ``path``; options as of :func:`counters`."""
    return interactions(counters(spark, path, labels, **options))

