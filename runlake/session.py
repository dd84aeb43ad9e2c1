"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every operator relies on.  All can be set on a running session.
SETTINGS = {
    # Every epoch, RFC3339 and date result is UTC.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: joins turn to broadcast only when the *measured* side is below
    # spark.sql.autoBroadcastJoinThreshold, and over-large shuffle partitions are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A JSON object with a repeated key is valid; its last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "runlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` uses ``__`` for dots in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    The base is the shared folder named by ``spark.checkpoint.dir``, else the session's
    warehouse, which every executor reaches as well.  Nothing deletes these folders while
    results that read them may be in use; the base can be emptied between jobs.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
