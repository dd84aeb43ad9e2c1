"""Paged, resumable ingest with idempotent merges: I1, I2.

The stream's checkpoint is the resume cursor.  Delivery is at least once: a batch that is
delivered again writes the same folder again, and merging by identity makes a repeated
record harmless.  Which batches a store holds is in the manifest, so whatever a crash came between,
the next call finds what is still to be merged.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Dataset
from ..plans.dataset import natural_key
from ..sources import record_lines

# Where a page lands says whose it is.
LANDED = r"/run_id=(\d+)/fetch=([^/]+)/"


def _pages(spark: SparkSession, landing: str, pages_per_batch: int) -> DataFrame:
    """Landed NDJSON pages as a stream of lines with their file and split."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", pages_per_batch).text(landing)
    return lines.select("value", "_metadata.file_path", "_metadata.file_block_start")


def _drained(pages: DataFrame, append, checkpoint: str) -> None:
    """Everything that has landed, batch by batch."""
    pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_pages(
    dataset: Dataset, record_type: str, run_id: int, landing: str, checkpoint: str,
    fetch: str = "1", queried: int | None = None, pages_per_batch: int = 100, fetched_at: Column | None = None,
) -> bool:
    """Take all pages landed so far into a run's fetch; run it again to resume.

    The fetch then waits for a merge if any of its pages is in no store.  Returns whether there were new pages.
    """
    new = []

    def append(batch: DataFrame, batch_id: int) -> None:
        dataset.add_page(record_type, run_id, record_lines(batch), fetch, f"{batch_id:09d}", fetched_at)
        new.append(batch_id)

    _drained(_pages(dataset.spark, landing, pages_per_batch), append, checkpoint)
    dataset.finish_fetch(record_type, run_id, fetch, queried)
    return bool(new)


def ingest_landing(
    dataset: Dataset, record_type: str, landing: str, checkpoint: str, pages_per_batch: int = 1000, fetched_at: Column | None = None,
) -> list[tuple[int, str]]:
    """I1 for all runs with one stream: pages land in ``<landing>/run_id=R/fetch=F/``.

    Every batch takes pages of all runs at once and deals them to their fetches.  A fetch whose pages
    have no records is one too.  ``fetched_at`` may depend on ``run_id``.  Returns the ``(run, fetch)`` there are.
    """
    # What is there now is what the stream will take at least.
    landed = [
        (int(run.removeprefix("run_id=")), fetch.removeprefix("fetch="))
        for run in dataset.storage.names(landing, "run_id=") for fetch in dataset.storage.names(f"{landing}/{run}", "fetch=")
    ]
    landed.sort(key=lambda f: (f[0], natural_key(f[1])))
    if not landed:
        return []

    def append(batch: DataFrame, batch_id: int) -> None:
        part = lambda group: F.regexp_extract("_path", LANDED, group)
        rows = record_lines(batch, {"run_id": part(1).cast("bigint"), "fetch": F.url_decode(part(2))})
        dataset.add_pages(record_type, rows, f"{batch_id:09d}", fetched_at)

    _drained(_pages(dataset.spark, f"{landing}/run_id=*/fetch=*", pages_per_batch), append, checkpoint)
    dataset.finish_fetches(record_type, landed)
    return landed


def merge_stream(
    dataset: Dataset, record_type: str, run_id: int, landing: str, checkpoint: str, fetch: str = "1", pages_per_batch: int = 100,
    fetched_at: Column | None = None,
) -> dict[str, int] | None:
    """Ingest what landed, then merge it.

    Pages that land after a merge of the run's current fetch open it again, and all its pages are merged with
    the late ones last.  A replay that brings no new page does nothing.
    """
    ingest_pages(dataset, record_type, run_id, landing, checkpoint, fetch, pages_per_batch=pages_per_batch, fetched_at=fetched_at)
    return dataset.merge(record_type, run_id)


def merge_landing(
    dataset: Dataset, record_type: str, landing: str, checkpoint: str, pages_per_batch: int = 1000, fetched_at: Column | None = None,
) -> dict[int, dict[str, int]]:
    """I2 for all runs: one stream, then one merge of all fetches that wait; the counts of their runs."""
    ingest_landing(dataset, record_type, landing, checkpoint, pages_per_batch, fetched_at)
    return dataset.merge_waiting(record_type)
