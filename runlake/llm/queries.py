"""The registered queries ``opN_<name>`` and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, work_dir
from . import filter_audit, fingerprints, html_text, mixing, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, repeated_passages, toxicity, urls, warc
from .common import WORD, n_words, ship_package, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, small Arrow batches (texts can be long) and this package on the executors."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    ship_package(spark)
    return spark


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows if there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


# Sizes, targets and the mix of a relation ``docs(doc_id, text, source)``.  ``times`` is how often a row is taken.
MIX_CTES = r"""
sized AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
  FROM docs),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
ordered AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS pos FROM weighed),
shares AS (
  SELECT *, 3 * source_size / weight AS ratio,
    CAST((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS share
  FROM ordered),
free AS (SELECT min(pos) AS pos FROM shares WHERE ratio > share),
targets AS (
  SELECT source, source_size, CASE WHEN f.pos IS NULL OR s.pos < f.pos THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * (SELECT share FROM shares z WHERE z.pos = f.pos) END AS target
  FROM shares s, free f),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS repeats FROM targets),
groups AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
sums AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM groups),
mix AS (
  SELECT d.*, b.source_size, b.target, least(b.repeats + CASE WHEN 2 * (s.upto - s.words) + s.words <= 2 * (b.target - b.repeats * b.source_size) THEN 1 ELSE 0 END, 3) AS times
  FROM sized d JOIN sums s ON s.source IS NOT DISTINCT FROM d.source AND s.h = d.h
  JOIN budgets b ON b.source IS NOT DISTINCT FROM d.source)
"""


@query(f"""
WITH docs AS (SELECT doc_id, text, source FROM documents), {MIX_CTES}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(times AS BIGINT) AS times, CAST(size * times AS BIGINT) AS taken FROM mix""")
def op8_source_mix(spark, sf):
    """Words that a mix of weights 1, 2, 3 takes from each document."""
    return mixing.mixed_sizes(table(spark, sf, "documents"))


@query()
def op9_packed_sequences(spark, sf):
    """All documents' token pieces packed into sequences of 2048."""
    return packing.packed(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
grouped AS (SELECT *, CAST(strlen(h) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last_id FROM payloads)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last_id THEN last_id END AS refers_to
FROM grouped""")
def op3_web_archive(spark, sf):
    """Every page archived, then read back from the archives."""
    path = work_dir(spark, "warc")
    warc.write_warc(table(spark, sf, "pages"), path)
    whole = warc.read_warc(spark, path, with_chunks=False).where("last")
    page = lambda name: F.regexp_extract(name, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    revisit = F.col("record_type") == "revisit"
    # A revisit has no payload of its own: its headers tell the size and digest of the full one.
    return whole.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"),
    )


URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@query(r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES
  ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
fitting AS (
  SELECT p.*, (SELECT max(struct_pack(n := length(r.rule), rule := r.rule, verdict := r.rule_verdict)) FROM rules r
    WHERE (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)) AS best
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM fitting""")
def op5_url_filter(spark, sf):
    """Every page's url judged by five rules."""
    return urls.judged(spark, table(spark, sf, "pages"), URL_RULES)


@query()
def op7_quality_rules(spark, sf):
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.judged(table(spark, sf, "documents"))


@query()
def op10_quality_classifier(spark, sf):
    """Score and verdict of the weakly supervised classifier for every document."""
    return quality_classifier.classified(table(spark, sf, "documents"))


@query()
def op2_near_duplicates(spark, sf):
    """Near-duplicate class of every document: shingles of four words, similarity 0.8."""
    return near_dedup.near_duplicates(table(spark, sf, "documents"), width=4)


@query()
def op6_fingerprints(spark, sf):
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprinted(table(spark, sf, "documents"))


@query()
def op4_toxicity(spark, sf):
    """Toxicity score of every document, learnt from the labels that are not held out."""
    return toxicity.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op1_main_text(spark, sf):
    """Main text of every page."""
    return html_text.extracted(table(spark, sf, "pages"))


AUDIT_ORDERS = r"""
filters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s))
"""


@query(rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
masked AS (
  SELECT part, doc_id, CAST(
      (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS INTEGER) AS mask
  FROM words),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM masked LEFT JOIN labels USING (doc_id) GROUP BY part, mask), {AUDIT_ORDERS},
audit AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM audit""")
def op11_filter_audit(spark, sf):
    """What each of five filters does at each step of all their orders, by source."""
    return filter_audit.audited(spark, f"{sf}/documents.parquet", table(spark, sf, "labels"))


def repeating(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; by the CRC of its id, one document in ten has a tail that repeats its own first words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), n_words(F.col("text"))
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    tail = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    chosen = (F.pmod(h, F.lit(10)) == 0) & (n > 0)
    return docs.select("doc_id", F.when(chosen, tail).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark, sf):
    """Runs of four periods or more in every document's words, and its words without the repeats."""
    found = periodic_runs.collapsed(repeating(table(spark, sf, "documents")))
    longer = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    order = lambda a, b: F.when(longer(a, b) != 0, -F.signum(longer(a, b))).otherwise(F.signum((a["start"] - b["start"]) * 2 + F.signum(a["period"] - b["period"])))
    best = F.get(F.array_sort("runs", lambda a, b: order(a, b).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_repeated_passages(spark, sf):
    """What is left of every document without strings of 200 bytes that also start elsewhere."""
    found = repeated_passages.without_repeats(table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
