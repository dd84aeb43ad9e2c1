"""Attachment references, index, content and result pairing over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import attachment_file, file_id12, sanitize_filename, state_markers, try_json
from runlake.operators import (
    attachment_content, attachment_files_dimension, attachment_index, attachment_index_refs, attachment_states,
    dedup_refs, membership_of, pair_results, pending_refs, scan_run_attachments, select_refs, unreferenced_files,
)

from . import shapes as S
from .registry import query


@query("""SELECT page_id, substr(sha256(url || '|' || html), 1, 12) AS id12 FROM pages""")
def file_ids(spark, sf):
    """H2 over whole pages."""
    return S.table(spark, sf, "pages").select("page_id", file_id12("url", "html").alias("id12"))


CLEAN = r"""rtrim(regexp_replace(rtrim(regexp_replace(replace(name, '\', '/'), '^.*/', '', 's'), '. '), '[^A-Za-z0-9._-]', '_', 'g'), '. ')"""


@query(rf"""
WITH names AS (SELECT page_id AS id, url AS name FROM pages
  UNION ALL SELECT doc_id, text FROM documents
  UNION ALL SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'con.' || p_name WHEN 1 THEN 'a\b/' || p_name || '. .' WHEN 2 THEN 'LPT9' WHEN 3 THEN '...' ELSE p_name || '/' END FROM part),
clean AS (SELECT id, name, {CLEAN} AS base FROM names),
filled AS (SELECT id, name, CASE WHEN base = '' THEN '_' ELSE base END AS base FROM clean)
SELECT id, md5(name) AS name_md5, CASE WHEN regexp_full_match(split_part(base, '.', 1), '(?i)(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])')
  THEN '_' || base ELSE base END AS file FROM filled""")
def sanitized_names(spark, sf):
    """H3 over urls, whole texts and awkward names."""
    part = S.table(spark, sf, "part")
    way = F.col("p_partkey") % 5
    awkward = (
        F.when(way == 0, F.concat(F.lit("con."), "p_name")).when(way == 1, F.concat(F.lit("a\\b/"), "p_name", F.lit(". .")))
        .when(way == 2, "LPT9").when(way == 3, "...").otherwise(F.concat("p_name", F.lit("/")))
    )
    names = S.union_all([
        S.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("name")),
        S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name")),
        part.select(F.col("p_partkey").alias("id"), awkward.alias("name")),
    ])
    return names.select("id", F.md5("name").alias("name_md5"), sanitize_filename(F.col("name")).alias("file"))


@query("""
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN lang || ' state?.json' ELSE '' END AS markers FROM documents""")
def markers_in_states(spark, sf):
    """H5: a marker inside a string is no marker."""
    rows = S.attachment_records(spark, sf)
    return rows.select("doc_id", F.array_join(state_markers(F.col("report_state")), ",").alias("markers"))


@query(f"""
WITH {S.REFS} SELECT collection, source, public_path, content_type, name, doc_id, state, remote_endpoint, question_id FROM refs""")
def attachment_references(spark, sf):
    """H4."""
    return S.refs(spark, sf).select(
        "collection", "source", "public_path", "content_type", "name", "doc_id", "state", "remote_endpoint", "question_id"
    )


@query(f"""
WITH {S.REFS} SELECT doc_id, public_path, state FROM refs WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""")
def run_attachments(spark, sf):
    """C4: a run that covers the documents labelled good."""
    records = S.attachment_records(spark, sf)
    good = S.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    fetched = records.join(good, "doc_id", "left_semi").withColumn("_run_id", F.lit(9))
    found = scan_run_attachments({"answers": records}, membership_of(fetched, "answers"), 9)
    return found.select("doc_id", "public_path", "state")


@query(f"""
WITH {S.REFS} SELECT doc_id, public_path FROM refs WHERE question_id = 'q1' AND name = 'en state?.json'""")
def selected_references(spark, sf):
    """B7."""
    return select_refs(S.refs(spark, sf), question="q1", name="en state?.json").select("doc_id", "public_path")


@query(f"""
WITH {S.REFS}
SELECT source, public_path, name, doc_id FROM refs
QUALIFY row_number() OVER (PARTITION BY source, public_path ORDER BY position, name, doc_id) = 1""")
def distinct_references(spark, sf):
    """D12."""
    return dedup_refs(S.refs(spark, sf)).select("source", "public_path", "name", "doc_id")


@query(f"""
WITH {S.REFS}, {S.FILES}, {S.INDEX} SELECT * FROM idx""")
def attachment_file_index(spark, sf):
    """D11."""
    return attachment_index(S.refs(spark, sf), S.files(spark, sf))


@query(f"""
WITH {S.REFS}, {S.FILES}, {S.INDEX} SELECT id12, name, source, public_path, content_type, size, file FROM idx""")
def attachment_files_view(spark, sf):
    """A11."""
    return attachment_files_dimension(attachment_index(S.refs(spark, sf), S.files(spark, sf)))


@query(f"""
WITH {S.REFS}
SELECT substr(sha256(source || '|' || public_path), 1, 12) AS id12, collection AS type, source_key, remote_endpoint, question_id FROM refs""")
def attachment_file_references(spark, sf):
    """References as rows."""
    return attachment_index_refs(S.refs(spark, sf)).drop("history_id")


VALID = "CASE WHEN TRY_CAST(content AS JSON) IS NOT NULL THEN md5(content) END"


@query(f"""
WITH {S.REFS}, {S.FILES}, {S.INDEX}
SELECT file AS filename, id12, name, md5(content) AS content_md5, {VALID} AS state_md5 FROM idx JOIN files USING (file) WHERE state""")
def attachment_state_texts(spark, sf):
    """B8, H6."""
    files = S.files(spark, sf)
    rows = attachment_states(attachment_index(S.refs(spark, sf), files), files)
    return rows.select("filename", "id12", "name", F.md5("content").alias("content_md5"), F.md5("state").alias("state_md5"))


@query(f"""
WITH {S.REFS}, {S.FILES}, {S.INDEX}
SELECT id12, name, source, public_path, file AS filename, md5(content) AS content_md5, {VALID} AS state_md5
FROM idx JOIN files USING (file) WHERE content_type IN ('application/json', 'text/plain', 'IMAGE/SVG+XML')""")
def attachment_texts(spark, sf):
    """B9."""
    files = S.files(spark, sf)
    rows = attachment_content(attachment_index(S.refs(spark, sf), files), files)
    return rows.select(
        "id12", "name", "source", "public_path", "filename", F.md5("content").alias("content_md5"), F.md5("state").alias("state_md5")
    )


@query("""
WITH texts AS (
  SELECT 'page' AS kind, page_id AS id, html AS content FROM pages UNION ALL SELECT 'props', event_id, props FROM events
  UNION ALL SELECT 'cut', event_id, props || ' x' FROM events UNION ALL SELECT 'single', event_id, replace(props, '"', '''') FROM events
  UNION ALL SELECT 'name', c_custkey, '"' || c_name || '"' FROM customer UNION ALL SELECT 'number', c_custkey, CAST(c_acctbal AS VARCHAR) FROM customer)
SELECT kind, id, TRY_CAST(content AS JSON) IS NOT NULL AS valid FROM texts""")
def valid_json(spark, sf):
    """H6: whole pages, good and bad JSON."""
    pages, events, customer = (S.table(spark, sf, t) for t in ("pages", "events", "customer"))

    def texts(df, kind, key, content):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), content.alias("content"))

    rows = S.union_all([
        texts(pages, "page", "page_id", F.col("html")), texts(events, "props", "event_id", F.col("props")),
        texts(events, "cut", "event_id", F.concat("props", F.lit(" x"))),
        texts(events, "single", "event_id", F.translate("props", '"', "'")),
        texts(customer, "name", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"'))),
        texts(customer, "number", "c_custkey", F.col("c_acctbal").cast("string")),
    ])
    return rows.select("kind", "id", try_json(F.col("content")).isNotNull().alias("valid"))


PAIRS = """refs_n AS (
  SELECT CAST(doc_id % 50 AS VARCHAR) AS doc, lang AS name, doc_id AS position,
         row_number() OVER (PARTITION BY doc_id % 50, lang ORDER BY doc_id) AS k FROM documents),
results_n AS (
  SELECT CAST(doc_id % 50 AS VARCHAR) AS doc, lang AS name, 'https://x.example/' || doc_id AS url,
         CASE WHEN n_chars % 5 = 0 THEN 'not found' ELSE '' END AS error,
         row_number() OVER (PARTITION BY doc_id % 50, lang ORDER BY doc_id * 3 + 1) AS k FROM documents)"""


def _pair_inputs(spark, sf):
    d = S.table(spark, sf, "documents")
    doc = (F.col("doc_id") % 50).cast("string").alias("doc_id")
    refs = d.select(doc, F.col("lang").alias("name"), F.col("doc_id").alias("position"))
    results = d.select(
        doc, F.col("lang").alias("name"), (F.col("doc_id") * 3 + 1).alias("position"),
        F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("n_chars") % 5 == 0, "not found").otherwise("").alias("error"),
    )
    return refs, results


@query(f"""
WITH {PAIRS} SELECT doc AS doc_id, name, k, position, url FROM refs_n JOIN results_n USING (doc, name, k) WHERE error = ''""")
def paired_results(spark, sf):
    """C7; small blocks so that one pair spans many of them."""
    paired, _ = pair_results(*_pair_inputs(spark, sf), block=100)
    return paired.select("doc_id", "name", "k", "position", "url")


@query(f"""
WITH {PAIRS} SELECT doc AS doc_id, name, k, error FROM refs_n JOIN results_n USING (doc, name, k) WHERE error <> ''""")
def missing_results(spark, sf):
    """Results that failed."""
    return pair_results(*_pair_inputs(spark, sf))[1]


@query(f"""
WITH {S.REFS}, strays AS (
  SELECT {S.FILE_NAME} AS file FROM refs UNION
  SELECT substr(sha256(url), 1, 12) || '_old.json' FROM pages)
SELECT file FROM strays WHERE file NOT IN (SELECT {S.FILE_NAME} FROM refs WHERE question_id <> 'q3')""")
def unreferenced_attachment_files(spark, sf):
    """Files of records that are gone, and strays."""
    refs = S.refs(spark, sf)
    on_disk = refs.select(attachment_file("source", "public_path", F.col("name")).alias("file")).union(
        S.table(spark, sf, "pages").select(F.concat(F.substring(F.sha2("url", 256), 1, 12), F.lit("_old.json")))
    ).distinct()
    return unreferenced_files(refs.where("question_id <> 'q3'"), on_disk)


@query(f"""
WITH {S.REFS}
SELECT doc_id, public_path, {S.FILE_NAME} AS file FROM refs
WHERE {S.FILE_NAME} NOT IN (SELECT {S.FILE_NAME} FROM refs WHERE question_id <> 'q3')""")
def pending_references(spark, sf):
    """Where an interrupted attachment fetch goes on."""
    refs = S.refs(spark, sf)
    there = refs.where("question_id <> 'q3'").select(attachment_file("source", "public_path", F.col("name")).alias("file"))
    return pending_refs(refs, there).select("doc_id", "public_path", "file")
