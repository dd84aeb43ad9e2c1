"""Manifest work over orders, customers and line items as provenance rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import (
    carry_provenance, dataset_listing, dataset_summary, dataset_totals, downloads_dimension, drift_report,
    newest_committed,
)

from . import shapes as S
from .registry import query


@query(f"WITH {S.DOWNLOADS} SELECT run_id, type, slug, report_type, complete FROM downloads")
def downloads_view(spark, sf):
    """A10."""
    return downloads_dimension(S.downloads(spark, sf))


@query(f"""
WITH {S.DOWNLOADS} SELECT type, run_id, job_id, slug, report_type, complete, row_count, recovered FROM downloads""")
def download_summary(spark, sf):
    """D7 for one dataset."""
    return dataset_summary(S.downloads(spark, sf))


@query("""
WITH versions AS (SELECT DISTINCT o_custkey AS dataset, o_orderkey % 5 + 1 AS version FROM orders),
members AS (SELECT DISTINCT o_custkey AS dataset, o_orderkey % 5 + 1 AS version FROM orders WHERE o_orderstatus = 'F')
SELECT dataset, coalesce(max(m.version), 0) AS version FROM versions v LEFT JOIN members m USING (dataset, version) GROUP BY dataset""")
def committed_versions(spark, sf):
    """D14."""
    o = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"), (F.col("o_orderkey") % 5 + 1).alias("version"), "o_orderstatus"
    )
    return newest_committed(o, o.where("o_orderstatus = 'F'"), ["dataset"])


@query(f"""
WITH {S.DOWNLOADS}
SELECT d.type, d.run_id, d.job_id, coalesce(nullif(p.slug, ''), '') AS slug,
  CASE WHEN p.type IS NOT NULL AND NOT p.recovered THEN coalesce(nullif(p.report_type, ''), 'recovered') ELSE 'recovered' END AS report_type,
  NOT coalesce(NOT p.recovered, false) AS recovered, coalesce(p.row_count, -1) AS coverage_n
FROM downloads d LEFT JOIN (SELECT * FROM downloads WHERE complete) p
  ON d.type = p.type AND d.run_id = p.run_id AND coalesce(d.job_id, -1) = coalesce(p.job_id, -1)""")
def carried_provenance(spark, sf):
    """The earlier manifest knows the complete downloads only."""
    d = S.downloads(spark, sf)
    rebuilt = d.select(
        "type", "run_id", "job_id", F.lit("").alias("slug"), F.lit("recovered").alias("report_type"),
        F.lit(True).alias("recovered"), F.lit(None).cast("struct<n:bigint>").alias("coverage"),
    )
    prior = d.where("complete").select(
        "type", "run_id", "job_id", "slug", "report_type", "recovered", F.struct(F.col("row_count").alias("n")).alias("coverage")
    )
    rows = carry_provenance(rebuilt, prior)
    return rows.select("type", "run_id", "job_id", "slug", "report_type", "recovered", F.coalesce("coverage.n", F.lit(-1)).alias("coverage_n"))


TOTALS = f"""{S.DOWNLOADS},
stores AS (SELECT 'portal/d' || c_nationkey AS ref, CASE WHEN c_acctbal < 0 THEN 'history' ELSE 'answers' END AS type, count(*) AS n FROM customer GROUP BY ALL),
totals AS (
  SELECT ref, type AS kind, CAST(n AS BIGINT) AS total FROM stores
  UNION ALL SELECT 'portal/d' || (custkey % 25), 'report', CAST(sum(row_count) AS BIGINT) FROM downloads WHERE type IN ('report', 'report_job') GROUP BY ALL
  UNION ALL SELECT 'portal/d' || (doc_id % 25), 'attachments', count(*) FROM documents GROUP BY ALL)"""


def _totals(spark, sf):
    portal = F.lit("portal/d")
    kind = F.when(F.col("c_acctbal") < 0, "history").otherwise("answers")
    stores = S.table(spark, sf, "customer").groupBy(F.concat(portal, F.col("c_nationkey").cast("string")).alias("ref"), kind.alias("type")).count()
    downloads = S.downloads(spark, sf).withColumn("ref", F.concat(portal, (F.col("custkey") % 25).cast("string")))
    attachments = S.table(spark, sf, "documents").select(F.concat(portal, (F.col("doc_id") % 25).cast("string")).alias("ref"))
    return dataset_totals(stores, downloads, attachments, ["ref"])


@query(f"WITH {TOTALS} SELECT * FROM totals")
def totals_per_dataset(spark, sf):
    """D6."""
    return _totals(spark, sf)


@query(f"""
WITH {TOTALS}
SELECT ref, 'D' || n_nationkey AS name, CAST(86400 * (n_nationkey + 1) AS BIGINT) AS age_seconds,
  (SELECT coalesce(sum(total), 0)::BIGINT FROM totals t WHERE t.ref = n.ref AND kind = 'answers') AS answers,
  (SELECT coalesce(sum(total), 0)::BIGINT FROM totals t WHERE t.ref = n.ref AND kind = 'history') AS history,
  (SELECT coalesce(sum(total), 0)::BIGINT FROM totals t WHERE t.ref = n.ref AND kind = 'report') AS report,
  (SELECT coalesce(sum(total), 0)::BIGINT FROM totals t WHERE t.ref = n.ref AND kind = 'attachments') AS attachments,
  (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents d WHERE d.doc_id % 25 = n_nationkey) AS size_bytes
FROM (SELECT *, 'portal/d' || n_nationkey AS ref FROM nation) n""")
def datasets_listed(spark, sf):
    """All datasets with age, totals and size."""
    portal = F.lit("portal/d")
    key = F.col("n_nationkey")
    created = F.timestamp_seconds(F.lit(1_700_000_000) - (key + 1) * 86400)
    manifests = S.table(spark, sf, "nation").select(
        F.concat(portal, key.cast("string")).alias("ref"), F.concat(F.lit("D"), key.cast("string")).alias("name"), created.alias("created_at")
    )
    sizes = S.table(spark, sf, "documents").select(
        F.concat(portal, (F.col("doc_id") % 25).cast("string")).alias("ref"), F.col("n_chars").alias("size")
    )
    return dataset_listing(manifests, _totals(spark, sf), sizes, F.timestamp_seconds(F.lit(1_700_000_000)))


@query(f"""
WITH {S.DOWNLOADS},
expected AS (
  SELECT '' AS subject, 'report_' || o_orderkey || '.csv' AS file, true AS download FROM orders
  UNION ALL SELECT 'membership answers/' || c_custkey, 'membership/v=1_answers/run_id=' || c_custkey, false FROM customer),
files AS (
  SELECT DISTINCT 'report_' || l_orderkey || '.csv' AS file FROM lineitem
  UNION SELECT 'membership/v=1_answers/run_id=' || o_custkey FROM orders
  UNION SELECT 'stores/history/v=' || s_suppkey FROM supplier
  UNION SELECT 'note_' || p_partkey || '.txt' FROM part)
SELECT 'MISSING_FILE' AS code, subject, file AS detail FROM expected WHERE NOT download AND file NOT IN (SELECT file FROM files)
UNION ALL SELECT 'INCOMPLETE', 'run ' || run_id, type FROM downloads WHERE NOT complete
UNION ALL SELECT 'RECOVERED_PROVENANCE', 'run ' || run_id, report_type FROM downloads WHERE recovered AND type LIKE 'report%'
UNION ALL SELECT 'UNKNOWN_TYPE', 'run ' || run_id, report_type FROM downloads WHERE type LIKE 'report%' AND report_type = 'coursework'
UNION ALL SELECT 'ORPHAN_FILE', file, '' FROM files WHERE (file LIKE 'membership/v=%' OR file LIKE 'stores/%' OR file LIKE 'report_%.csv')
  AND file NOT IN (SELECT file FROM expected)""")
def drift(spark, sf):
    """G5."""
    orders, customer, supplier, part = (S.table(spark, sf, t) for t in ("orders", "customer", "supplier", "part"))
    li = S.table(spark, sf, "lineitem")

    def name(before, key, after):
        return F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after)).alias("file")

    expected = orders.select(F.lit("").alias("subject"), name("report_", "o_orderkey", ".csv"), F.lit(True).alias("download")).union(
        customer.select(
            F.concat(F.lit("membership answers/"), F.col("c_custkey").cast("string")),
            name("membership/v=1_answers/run_id=", "c_custkey", ""), F.lit(False),
        )
    )
    files = S.union_all([
        li.select(name("report_", "l_orderkey", ".csv")), orders.select(name("membership/v=1_answers/run_id=", "o_custkey", "")),
        supplier.select(name("stores/history/v=", "s_suppkey", "")), part.select(name("note_", "p_partkey", ".txt")),
    ])
    return drift_report(expected, S.downloads(spark, sf), files, owned=r"^(membership/v=|stores/|report_.*\.csv$)")
