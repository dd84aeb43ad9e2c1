"""A dataset at rest: versioned stores, memberships, reports, attachments, manifest.

Layout below ``root`` (any file system Spark reads)::

    manifest/commit=N/            one JSON row per entry; the highest N is current
    segments/<type>/fetch=F/run_id=R/batch=B/
    staging/<type>/id=I/                work tables of the merge under way
    stores/<type>/v=N/id=I/records/     identity, stamps, record text of the buckets that the merge wrote
    stores/<type>/v=N/id=I/columns/     the same records as typed columns
    stores/<type>/v=N/id=I/kinds/       kinds of values by bucket and field
    stores/<type>/v=N/id=I/buckets/     where all buckets of this version are
    membership/v=N_<type>/id=I/type=T/run_id=R/
    runs/v=N_<type>/id=I/               which runs that membership is about, empty ones too
    reports/report_<run>[_job_<id>].csv
    attachments/                        downloaded files
    attachment_missing/run_id=R/        references that could not be fetched
    attachment_index/v=N/id=I/

Stores are cut into buckets by the hash of the identity.  A merge reads and writes only buckets that it
touches; the manifest names the folder of every other one where an earlier merge put it.

A run has one current fetch, its newest.  The manifest lists the batches of it that a store holds, so a
page that came later, or came just before a crash, is seen to be missing; a page of an older fetch is left.

A merge writes into folders of its own id, then commits one manifest file that must not exist
yet, and readers only follow the manifest.  Of two writers that start from one commit the second
finds the number taken: it removes what it wrote and merges anew on top of the first.  A merge
that dies leaves unreferenced folders and nothing else; :meth:`Dataset.drift` names them and
:meth:`Dataset.vacuum` removes them.
"""

from __future__ import annotations

import json
import re
import uuid
import warnings
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import cache
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_text_content_type, key_columns, report_type_from_slug
from ..operators import (
    attachment_index, attachment_refs, carry_provenance, dataset_listing, dataset_summary, dataset_totals, dedup_refs,
    describe_csv, double_decode, drift_report, membership_of, merge_store,
    newest_committed, normalize_identity, pending_refs, recover_report_type, scan_run_attachments, unreferenced_files,
)
from ..sources import (
    append_batches, append_records, arrow_opens, failed_casts, has_multiline_cells, list_files, read_batches, read_cells, read_membership,
    read_chosen_texts, read_text_files, scan_report_csv, type_records, typed_empty, with_identity, write_membership,
)
from ..sources.buckets import BUCKET, NONE, bucket_of, column_kinds, fitted, in_buckets, write_buckets, write_kinds
from ..sources.storage import Storage
from .views import DatasetFrames, ReportRun, register_views

MANIFEST_SCHEMA = """
kind string, name string, description string, created_at timestamp,
type string, run_id bigint, job_id bigint, fetch string, version bigint, path string, count bigint,
slug string, report_type string, source_key string, filters string, filter_labels array<string>,
files array<string>,
coverage struct<queried:bigint,with_data:bigint,empty:bigint,missing:array<struct<doc_id:string,name:string,error:string>>>,
merge_counts struct<fetched:bigint,new:bigint,updated:bigint,removed:bigint>,
history_mode string, complete boolean, fetched_at timestamp, scanned array<string>, row_count bigint,
columns map<string,string>, column_order array<string>, multiline boolean, recovered boolean, merged_as bigint,
bucket_count int, buckets array<struct<bucket:int,path:string,layout:int>>, layouts array<map<string,string>>,
sequence bigint, superseded boolean, batches array<string>, file_stamp string
"""
# Buckets of a new dataset's stores; best so many that one holds about a gigabyte.
BUCKETS = 32
ATTEMPTS = 5
DECODED = ("report_state", "report_state_raw", "interactive_state_raw", "_decode_error")
# Columns that a store keeps beside the record text, so that they are not read from it.
STAMPED = sorted({"_fetched_at", "_run_id", *DECODED})


class CommitConflict(RuntimeError):
    """Another writer committed first; the dataset is as that writer left it."""


class Dataset:
    """One dataset folder.  Entries are plain dicts with the fields of the manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.storage = Storage(spark, self.root)

    # ---- manifest ------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, description: str = "", buckets: int = BUCKETS) -> Dataset:
        ds = cls(spark, root)
        ds._commit([{"kind": "dataset", "name": name, "description": description, "created_at": _now(), "bucket_count": buckets}], 1)
        return ds

    def manifest(self) -> DataFrame:
        """Rows of the newest commit."""
        return self.spark.read.schema(MANIFEST_SCHEMA).json(f"{self.root}/manifest/commit={self._newest()}")

    def _newest(self) -> int:
        commits = [int(n.removeprefix("commit=")) for n in self.storage.names(f"{self.root}/manifest", "commit=")]
        if not commits:
            raise FileNotFoundError(f"{self.root} has no manifest")
        return max(commits)

    def _entries(self) -> tuple[int, list[dict[str, Any]]]:
        """The newest commit and its rows: provenance, never data."""
        newest = self._newest()
        lines = self.storage.read(f"{self.root}/manifest/commit={newest}/manifest.json").splitlines()
        found = [dict.fromkeys(_fields()) | json.loads(line) for line in lines if line]
        for e in found:
            e |= {c: datetime.fromisoformat(e[c]) for c in ("created_at", "fetched_at") if e[c]}
        return newest, found

    def _commit(self, entries: Sequence[Mapping[str, Any]], commit: int) -> None:
        rows = [{k: v for k, v in e.items() if v is not None and k in _fields()} for e in entries]
        lines = "".join(json.dumps(r, ensure_ascii=False, default=lambda t: t.astimezone(timezone.utc).isoformat()) + "\n" for r in rows)
        # One file, so a commit appears whole; an existing commit number is a lost race.
        if not self.storage.create(f"{self.root}/manifest/commit={commit}/manifest.json", lines):
            raise CommitConflict(f"commit {commit} of {self.root} exists already")

    def _update(self, change) -> None:
        """Apply a small change to the newest manifest, again if another writer was faster."""
        for attempt in range(ATTEMPTS):
            commit, entries = self._entries()
            try:
                return self._commit(change(entries), commit + 1)
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise

    def downloads(self) -> DataFrame:
        return self.manifest().where("kind = 'download'")

    # ---- ingest --------------------------------------------------------------------

    def add_page(self, record_type: str, run_id: int, lines: DataFrame, fetch: str, batch: str, fetched_at: Column | None = None) -> None:
        """Decode raw records (``record``, ``_position``) and append them to a fetch."""
        rows = double_decode(with_identity(lines, record_type))
        stamp_at = F.current_timestamp() if fetched_at is None else fetched_at
        append_records(rows, self._segment(record_type, fetch), stamp_at, run_id, batch)

    def add_pages(self, record_type: str, lines: DataFrame, batch: str, fetched_at: Column | None = None) -> None:
        """I1 for many runs: ``record, _position, run_id, fetch`` rows of one batch, each to its run's fetch.

        ``fetched_at`` may depend on ``run_id``.  A batch that is delivered again replaces its own folders.
        """
        rows = double_decode(with_identity(lines, record_type)).withColumn("run_id", F.col("run_id").cast("bigint"))
        stamp_at = F.current_timestamp() if fetched_at is None else fetched_at
        append_batches(rows, f"{self.root}/segments/{record_type}", stamp_at, batch)

    def finish_fetch(self, record_type: str, run_id: int, fetch: str, queried: int | None = None) -> None:
        """All pages of a fetch that landed so far are in; see :meth:`finish_fetches`."""
        self.finish_fetches(record_type, [(run_id, fetch)], queried)

    def finish_fetches(self, record_type: str, fetches: Sequence[tuple[int, str]], queried: int | None = None) -> None:
        """The pages of these ``(run, fetch)`` are in; what no store holds yet waits for a merge.

        A fetch that was not known before becomes its run's current one, and replaces older ones for good, be
        they merged or waiting.  The current fetch waits again if it has batches that were not merged.  New
        batches of a replaced fetch are left where they are, with a warning.
        """
        landed = {f: self._batches(record_type, *f) for f in fetches}

        def change(entries):
            for (run, fetch), batches in landed.items():
                entries = self._finished(entries, record_type, run, fetch, batches, queried)
            return entries

        self._update(change)

    def _finished(self, entries, record_type: str, run: int, fetch: str, batches: list[str], queried: int | None) -> list:
        own = [e for e in entries if _is(e, "segment", record_type, run)]
        known = next((e for e in own if e["fetch"] == fetch), None)
        if known is None:
            segment = {
                "kind": "segment", "type": record_type, "run_id": run, "fetch": fetch, "count": queried,
                "sequence": 1 + max((e["sequence"] or 0 for e in own), default=0),
            }
            started = {
                "kind": "download", "type": record_type, "run_id": run, "complete": False, "fetched_at": _now(),
                "history_mode": "full" if record_type == "history" else None,
            }
            return _upsert([{**e, "superseded": True} if e in own else e for e in entries], started) + [segment]
        new = sorted(set(batches) - set(known["batches"] or []))
        if not new or known["merged_as"] is None and not known["superseded"]:
            return entries
        if known["superseded"]:
            warnings.warn(f"{record_type} run {run}: pages of fetch {fetch}, which a newer one replaced, are left out ({', '.join(new)})", stacklevel=4)
            return entries
        return [{**e, "merged_as": None} if e is known else e for e in entries]

    def _batches(self, record_type: str, run_id: int, fetch: str) -> list[str]:
        """Batches of a fetch on disk."""
        folder = f"{self._segment(record_type, fetch)}/run_id={run_id}"
        return [n.removeprefix("batch=") for n in self.storage.names(folder, "batch=")]

    def is_merged(self, record_type: str, run_id: int, fetch: str) -> bool:
        return any(
            _is(e, "segment", record_type, run_id) and e["fetch"] == fetch and e["merged_as"] is not None
            for e in self._entries()[1]
        )

    def _segment(self, record_type: str, fetch: str) -> str:
        return f"{self.root}/segments/{record_type}/fetch={fetch}"

    # ---- merge ---------------------------------------------------------------------

    def merge(self, record_type: str, run_id: int, sweep: bool = True) -> dict[str, int] | None:
        """Merge a run's waiting fetch, and with ``sweep`` all other waiting ones.

        Returns the counts of ``run_id``, or None when it has nothing to merge.  A writer that finds
        another commit in its way starts again from that; if it merged the fetch, its counts are returned.
        """
        counts, attempt = self._merged(record_type, run_id, sweep)
        if not counts and attempt:
            return next((e["merge_counts"] for e in self._entries()[1] if _is(e, "download", record_type, run_id)), None)
        return counts.get(run_id)

    def merge_waiting(self, record_type: str) -> dict[int, dict[str, int]]:
        """Merge all waiting fetches at once; the counts of their runs, none if nothing waits."""
        return self._merged(record_type, None, True)[0]

    def _merged(self, record_type: str, run_id: int | None, sweep: bool) -> tuple[dict[int, dict[str, int]], int]:
        """Counts per run, and how often another writer came first."""
        for attempt in range(ATTEMPTS):
            try:
                return self._merge(record_type, run_id, sweep), attempt
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise

    def _merge(self, record_type: str, run_id: int | None, sweep: bool) -> dict[int, dict[str, int]]:
        commit, entries = self._entries()
        waiting = [e for e in entries if e["kind"] == "segment" and e["type"] == record_type and e["merged_as"] is None and not e["superseded"]]
        if not waiting or run_id is not None and not any(e["run_id"] == run_id for e in waiting):
            return {}
        run_id = waiting[0]["run_id"] if run_id is None else run_id
        if not sweep:
            waiting = [e for e in waiting if e["run_id"] == run_id]
        current = next((e for e in entries if e["kind"] == "store" and e["type"] == record_type), None)
        n = self._bucket_count(entries)
        version, own = (current["version"] if current else 0) + 1, f"id={uuid.uuid4().hex[:12]}"
        path, members = f"stores/{record_type}/v={version}/{own}", f"membership/v={version}_{record_type}/{own}"
        runs, stage = f"runs/v={version}_{record_type}/{own}", f"{self.root}/staging/{record_type}/{own}"

        batches = {(e["run_id"], e["fetch"]): self._batches(record_type, e["run_id"], e["fetch"]) for e in waiting}
        segments = read_batches(self.spark, f"{self.root}/segments/{record_type}", batches, record_type)
        merging = [run_id, *(e["run_id"] for e in waiting if e["run_id"] != run_id)]
        before = self._membership(entries)
        live = {b["bucket"]: b for b in current["buckets"]} if current else {}
        # Without a store there is nothing that a bucket could keep.
        touched = self._touched(record_type, segments, before, merging, n) if current else list(range(n))
        there = [b for b in touched if b in live]
        old = self._records(live, there) if there else None
        others = None if before is None else in_buckets(before, record_type, n, touched)
        result = merge_store(old, segments, others, record_type, merging, stage=stage)
        counts, changed = self._counted(f"{stage}/decided", record_type, n, merging)
        rows = result.store.drop("_status")
        rows = rows if len(changed) == len(touched) else in_buckets(rows, record_type, n, changed)
        write_buckets(rows, f"{self.root}/{path}/records", record_type, n)
        buckets, layouts, columns = self._named_buckets(path, live, current, changed)
        write_membership(membership_of(segments, record_type), f"{self.root}/{members}")
        covered = self._covered(segments, members)
        for run, count in counts.items():
            count["fetched"] = covered.get(run, (0, 0, 0))[0]
        total = (current["count"] if current else 0) + sum(c["new"] - c["removed"] for c in counts.values())
        self._write_list(runs, [{"run_id": r} for r in counts])

        done = []
        for e in entries:
            if e["kind"] == "store" and e["type"] == record_type:
                continue
            if e["kind"] == "membership" and e["type"] == record_type and e["run_id"] in counts:
                continue
            if e in waiting:
                e = {**e, "merged_as": version, "batches": batches[e["run_id"], e["fetch"]]}
            if e["kind"] == "download" and e["type"] == record_type and e["run_id"] in counts:
                asked = next(w["count"] for w in waiting if w["run_id"] == e["run_id"])
                got = covered.get(e["run_id"], (0, 0, 0))[2]
                e = {
                    **e, "complete": True, "merge_counts": counts[e["run_id"]],
                    "coverage": {"queried": asked, "with_data": got, "empty": None if asked is None else asked - got, "missing": None},
                }
            done.append(e)
        done.append({
            "kind": "store", "type": record_type, "version": version, "path": path, "count": total, "columns": columns,
            "buckets": buckets, "layouts": layouts,
        })
        done += [
            {"kind": "membership", "type": record_type, "run_id": r, "version": version, "count": covered.get(r, (0, 0, 0))[1],
             "path": f"{members}/type={record_type}/run_id={r}"}
            for r in counts
        ]
        try:
            self._commit(done, commit + 1)
        except CommitConflict:
            for folder in (path, members, runs):
                self.storage.delete(f"{self.root}/{folder}")
            raise
        finally:
            self.storage.delete(stage)
        return counts

    def _write_list(self, folder: str, rows: Sequence[Mapping[str, Any]]) -> None:
        """A short list of provenance as a file of JSON lines that appears whole."""
        self.storage.create(f"{self.root}/{folder}/list.json", "".join(json.dumps(r) + "\n" for r in rows))

    def _read_list(self, folder: str) -> list[dict[str, Any]]:
        return [json.loads(line) for line in self.storage.read(f"{self.root}/{folder}/list.json").splitlines()]

    def _bucket_count(self, entries) -> int:
        return next((e["bucket_count"] for e in entries if e["kind"] == "dataset" and e["bucket_count"]), BUCKETS)

    def _touched(self, record_type: str, segments: DataFrame, members: DataFrame | None, merging: Sequence[int], n: int) -> list[int]:
        """Buckets that a merge may change: of the identities delivered now, or covered by these runs until now."""
        ids = normalize_identity(segments, record_type).select(bucket_of(record_type, n).alias(BUCKET))
        if members is not None:
            until = members.where((F.col("type") == record_type) & F.col("run_id").isin(*merging))
            ids = ids.union(until.select(bucket_of(record_type, n)))
        return sorted(r[0] for r in ids.distinct().collect())  # at most a row per bucket

    def _records(self, live: Mapping[int, Mapping[str, Any]], buckets: Sequence[int]) -> DataFrame:
        """Identity, stamps and record text of buckets."""
        return self._bucket_files(live, buckets, "records")

    def _bucket_files(self, live: Mapping[int, Mapping[str, Any]], buckets: Sequence[int], form: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{live[b]['path']}/{form}/{BUCKET}={b}" for b in buckets])

    def _counted(self, decided: str, record_type: str, n: int, merging: Sequence[int]) -> tuple[dict[int, dict[str, int]], list[int]]:
        """D3 without ``fetched``, and the buckets in which anything changed, from the decisions; a row per bucket and run."""
        dropped = F.col("_old") & ~F.col("_source") & ~F.col("_other")
        rows = self.spark.read.parquet(decided).where(F.col("_source") | dropped).groupBy(bucket_of(record_type, n).alias("bucket"), "_run").agg(
            F.count_if(F.col("_source") & ~F.col("_old")).alias("new"), F.count_if(F.col("_source") & F.col("_old")).alias("updated"),
            F.count_if(dropped).alias("removed"),
        ).collect()
        counts = {run: {"fetched": 0, "new": 0, "updated": 0, "removed": 0} for run in merging}
        for r in rows:
            for name in ("new", "updated", "removed"):
                # An identity that nobody delivers has no run; its removal is the primary run's.
                if r[name]:
                    counts[merging[0] if name == "removed" else r["_run"]][name] += r[name]
        return counts, sorted({r["bucket"] for r in rows})

    def _covered(self, segments: DataFrame, members: str) -> dict[int, tuple[int, int, int]]:
        """Per run its records, distinct identities and distinct endpoints, from the membership just written."""
        # A membership holds an identity once, so its lines are counted and only endpoints are told apart.
        ids = self.spark.read.schema("remote_endpoint string, run_id bigint").json(f"{self.root}/{members}")
        per_endpoint = ids.groupBy("run_id", "remote_endpoint").agg(F.count(F.lit(1)).alias("ids"))
        found = per_endpoint.groupBy("run_id").agg(F.sum("ids").alias("ids"), F.count(F.lit(1)).alias("endpoints"))
        records = segments.groupBy(F.col("_run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"))
        return {r["run_id"]: (r["n"], r["ids"], r["endpoints"]) for r in records.join(found, "run_id").collect()}

    def _named_buckets(self, path: str, live, current, changed: Sequence[int]) -> tuple[list[dict], list[dict], dict[str, str]]:
        """Type the buckets just written; ``(buckets, layouts, columns)`` of the new version.

        The column map comes from kinds: those of the new buckets are counted now, those of others when they
        were written.  Buckets of an older map stay as they are and are fitted when read.
        """
        # A changed bucket may have ended up empty; then it has no folder.
        fresh = [int(b.removeprefix(f"{BUCKET}=")) for b in self.storage.names(f"{self.root}/{path}/records", f"{BUCKET}=")]
        layouts = [dict(m) for m in current["layouts"]] if current else []
        kept = {b: e for b, e in live.items() if b not in changed}
        records = self.spark.read.parquet(f"{self.root}/{path}/records") if fresh else None
        if fresh:
            write_kinds(records, f"{self.root}/{path}/kinds")
        folders = {b: f"{self.root}/{e['path']}" for b, e in kept.items()} | {b: f"{self.root}/{path}" for b in fresh}
        kinds = column_kinds(self.spark, folders)
        columns, layout = {c: t for c, (t, _) in kinds.items()}, {c: NONE if none else t for c, (t, none) in kinds.items()}
        if layout not in layouts:
            layouts.append(layout)
        if fresh:
            typed = type_records(records, {c: t for c, t in columns.items() if c not in STAMPED}, keep=[*STAMPED, BUCKET])
            typed.write.partitionBy(BUCKET).parquet(f"{self.root}/{path}/columns")
        named = [{"bucket": b, "path": e["path"], "layout": e["layout"]} for b, e in kept.items()]
        named += [{"bucket": b, "path": path, "layout": layouts.index(layout)} for b in fresh]
        used = sorted({b["layout"] for b in named} | {layouts.index(layout)})
        named = [{**b, "layout": used.index(b["layout"])} for b in sorted(named, key=lambda b: b["bucket"])]
        layouts = [layouts[i] for i in used]
        # Written last: a version that has it has everything.
        self._write_list(f"{path}/buckets", [{"bucket": b["bucket"], "path": b["path"], "types": layouts[b["layout"]]} for b in named])
        return named, layouts, columns

    def _membership(self, entries) -> DataFrame | None:
        """Current memberships; a file the manifest names but that is gone is an error."""
        paths = [f"{self.root}/{e['path']}" for e in entries if e["kind"] == "membership" and e["count"] != 0]
        if not paths:
            return None
        parts = {}
        for p in paths:
            parts.setdefault(p[: p.index("/type=")], []).append(p)
        frames = [read_membership(self.spark, ps, base) for base, ps in sorted(parts.items())]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    # ---- reports -------------------------------------------------------------------

    def add_report(self, run_id: int, file: str, slug: str = "", server_type: str | None = None, job_id: int | None = None, **labels: Any) -> dict[str, Any]:
        """Record a report CSV below ``root``: its type, row count, columns and order."""
        one = self.spark.createDataFrame([(slug, server_type)], "slug string, server string")
        report_type = one.select(report_type_from_slug(F.col("slug"), F.col("server"))).head()[0]
        entry = {
            "kind": "download", "type": "report" if job_id is None else "report_job", "run_id": run_id, "job_id": job_id,
            "slug": slug, "report_type": report_type, "files": [file], "complete": True, "fetched_at": _now(), **labels,
            **self._describe_csv(file, report_type),
        }
        self._update(lambda entries: _upsert(entries, entry))
        return entry

    def _describe_csv(self, file: str, report_type: str) -> dict[str, Any]:
        path = f"{self.root}/{file}"
        multiline = has_multiline_cells(self.spark, path)
        cells = read_cells(self.spark, path, multiline=multiline)
        found = describe_csv(cells, report_type).head()
        return {
            "row_count": found["row_count"],
            "columns": {c["column"]: c["type"] for c in found["columns"]},
            "column_order": [c["column"] for c in found["columns"]],
            "multiline": multiline, "file_stamp": self._stamp_of(file),
        }

    def _stamp_of(self, file: str) -> str:
        """Size and time of a report file, to tell whether it changed since its types were recorded."""
        path = f"{self.root}/{file}"
        return f"{self.storage.size(path)}:{self.storage.modified(path)}"

    def _failed_casts(self, e: Mapping[str, Any]) -> list[tuple[str, str, int]]:
        """``(column, type, cells)`` that the recorded types cannot hold; a file that did not change is not read again."""
        file = e["files"][0]
        if not self.storage.exists(f"{self.root}/{file}") or self._stamp_of(file) == e["file_stamp"]:
            return []
        found = failed_casts(self.spark, f"{self.root}/{file}", e["columns"], e["column_order"] or [], multiline=e["multiline"])
        return [tuple(r) for r in found.collect()]  # a row per column

    def _report(self, e: Mapping[str, Any]) -> ReportRun:
        """A report's rows; a missing file costs its own rows, not the union's schema."""
        path = f"{self.root}/{e['files'][0]}"
        try:
            rows = scan_report_csv(
                self.spark, path, e["columns"], e["column_order"] or [], e["run_id"], multiline=bool(e["multiline"])
            ).drop("run_id")
        except AnalysisException:
            warnings.warn(f"report file {path} is missing; it contributes no rows", stacklevel=2)
            order = e["column_order"] or sorted(e["columns"])
            rows = typed_empty(self.spark, {c: e["columns"][c] for c in order})
        for column, kind, cells in self._failed_casts(e):
            warnings.warn(f"report file {path} changed: {cells} cells of {column} are no {kind} and read as NULL", stacklevel=3)
        return ReportRun(e["run_id"], e["report_type"], rows, e["job_id"])

    # ---- attachments ---------------------------------------------------------------

    def _typed(self, entries, record_type: str) -> DataFrame | None:
        """The store as typed columns; buckets typed under an older column map are fitted to the current one."""
        e = next((e for e in entries if e["kind"] == "store" and e["type"] == record_type), None)
        if e is None:
            return None
        live, frames = {b["bucket"]: b for b in e["buckets"]}, []
        newest = {c: t for c, t in e["columns"].items()}
        for layout, types in enumerate(e["layouts"]):
            own = [b for b, x in live.items() if x["layout"] == layout]
            if not own:
                continue
            shown = {c: "VARCHAR" if t == NONE and newest.get(c) == "VARCHAR" else t for c, t in types.items()}
            typed = fitted(self._bucket_files(live, own, "columns"), shown, newest, STAMPED)
            if typed is None:
                fields = {c: t for c, t in newest.items() if c not in STAMPED}
                typed = type_records(self._records(live, own), fields, keep=STAMPED)
            frames.append(typed)
        if not frames:
            return typed_empty(self.spark, newest)
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _refs_input(self, entries, record_type: str) -> DataFrame | None:
        store = self._typed(entries, record_type)
        if store is None:
            return None
        for column in ("attachments", "report_state", "id"):
            if column not in store.columns:
                store = store.withColumn(column, F.lit(None).cast("string"))
        return store

    def attachment_refs(self, run_id: int | None = None) -> DataFrame:
        """H4, C4: references in all current records, or in those one run covers."""
        entries = self._entries()[1]
        stores = {t: self._refs_input(entries, t) for t in ("answers", "history")}
        if run_id is not None:
            covered = {e["type"] for e in entries if e["kind"] == "membership" and e["run_id"] == run_id}
            found = {t: s for t, s in stores.items() if s is not None and t in covered}
            return scan_run_attachments(found, self._membership(entries), run_id)
        refs = [attachment_refs(s, t) for t, s in stores.items() if s is not None]
        if not refs:
            raise LookupError("the dataset has neither answers nor history")
        return refs[0] if len(refs) == 1 else refs[0].unionByName(refs[1])

    def index_attachments(self) -> DataFrame:
        """Rebuild the index over the files present; returns G6, the unreferenced ones."""
        entries = self._entries()[1]
        refs = self.attachment_refs()
        files = self._attachments().select("file", "size")
        old = next((e for e in entries if e["kind"] == "attachments"), None)
        version = (old["version"] if old else 0) + 1
        path = f"attachment_index/v={version}/id={uuid.uuid4().hex[:12]}"
        attachment_index(refs, files).write.parquet(f"{self.root}/{path}")
        count = self.spark.read.parquet(f"{self.root}/{path}").count()
        entry = {"kind": "attachments", "version": version, "path": path, "count": count}
        self._update(lambda entries: [e for e in entries if e["kind"] != "attachments"] + [entry])
        return unreferenced_files(refs, files)

    def _attachments(self) -> DataFrame:
        """The attachment files there are; none without a folder."""
        try:
            return list_files(self.spark, f"{self.root}/attachments")
        except AnalysisException:
            return typed_empty(self.spark, {"file": "VARCHAR", "path": "VARCHAR", "size": "BIGINT"})

    def _texts(self, index: DataFrame) -> DataFrame | None:
        """Texts of the files that the index calls a state or a text; no other file is opened where Arrow can open them."""
        folder = f"{self.root}/attachments"
        if not self.storage.exists(folder):
            return None
        if not arrow_opens(self.root):
            return read_text_files(self.spark, folder)
        wanted = index.where(F.col("state") | is_text_content_type(F.col("content_type"))).select("file").distinct()
        return read_chosen_texts(self._attachments().join(wanted, "file", "left_semi"))

    def pending_attachments(self, run_id: int) -> DataFrame:
        """References of a run that still have to be fetched, once per file."""
        refs = dedup_refs(self.attachment_refs(run_id))
        return pending_refs(refs, self._attachments())

    def record_attachments(self, run_id: int, paired: DataFrame, failed: DataFrame) -> None:
        """Record the outcome of an attachment fetch (C7): how many came, and which did not.

        The failures are a table of their own, as there is no bound on them.
        """
        path = f"attachment_missing/run_id={run_id}"
        failed.select("doc_id", "name", "error").write.mode("overwrite").parquet(f"{self.root}/{path}")
        types = sorted({t for t, r in self.frames().member_runs if r == run_id})
        entry = {
            "kind": "download", "type": "attachments", "run_id": run_id, "complete": True, "fetched_at": _now(), "scanned": types,
            "path": path, "coverage": {"queried": None, "with_data": paired.count(), "empty": None, "missing": None},
        }
        self._update(lambda entries: _upsert(entries, entry))

    # ---- queries -------------------------------------------------------------------

    def frames(self) -> DatasetFrames:
        entries = self._entries()[1]
        reports = [e for e in entries if e["kind"] == "download" and e["type"] in ("report", "report_job") and e["files"] and e["columns"]]
        index = next((e for e in entries if e["kind"] == "attachments"), None)
        attachments = None if index is None else self.spark.read.parquet(f"{self.root}/{index['path']}")
        return DatasetFrames(
            name=next(e["name"] for e in entries if e["kind"] == "dataset"),
            stores={t: s for t in ("answers", "history") if (s := self._typed(entries, t)) is not None},
            membership=self._membership(entries),
            member_runs=sorted((e["type"], e["run_id"]) for e in entries if e["kind"] == "membership"),
            downloads=self.downloads(),
            reports=[self._report(e) for e in reports],
            attachments=attachments,
            texts=None if attachments is None else self._texts(attachments),
        )

    def register(self) -> list[str]:
        """K1 for this dataset alone."""
        return register_views(self.spark, [(None, self.frames())])

    def totals(self) -> DataFrame:
        """D6."""
        rows = self.manifest()
        stores = rows.where("kind = 'store'").select("type", "count")
        attachments = rows.where("kind = 'attachments'").select(F.lit("attachments").alias("type"), "count")
        return dataset_totals(stores.unionByName(attachments), rows.where("kind = 'download'"), rows.where(F.lit(False)))

    def summary(self) -> DataFrame:
        """D7."""
        return dataset_summary(self.downloads())

    def drift(self) -> DataFrame:
        """G5 over the report files of this dataset and the memberships of its manifest; ``FAILED_CAST`` rows for changed reports."""
        rows = self.manifest()
        subject = F.concat_ws(" ", "kind", F.concat_ws("/", "type", F.col("run_id").cast("string"))).alias("subject")
        # A run without records has a membership without files.
        named = rows.where("kind = 'store' or kind = 'membership' and count <> 0").select(subject, F.col("path").alias("file"), F.lit(False).alias("download"))
        elsewhere = rows.where("kind = 'store'").select(subject, F.explode("buckets.path").alias("file"), F.lit(False).alias("download"))
        named = named.unionByName(elsewhere).distinct()
        listed = self._folders().select("file")
        csvs = rows.where("kind = 'download'").select(F.lit("").alias("subject"), F.explode("files").alias("_f"), F.lit(True).alias("download"))
        csvs = csvs.select("subject", F.substring_index("_f", "/", -1).alias("file"), "download")
        found = drift_report(named.unionByName(csvs), rows.where("kind = 'download'"), listed)
        failed = [
            ("FAILED_CAST", f"run {e['run_id']}", f"{column}: {cells} cells are no {kind}")
            for e in self._entries()[1] if e["kind"] == "download" and e["files"] and e["columns"] for column, kind, cells in self._failed_casts(e)
        ]
        found = found.unionByName(self.spark.createDataFrame(failed, "code string, subject string, detail string")) if failed else found
        return found.orderBy("code", "subject", "detail")

    def _versions(self, top: str) -> list[str]:
        """Folders ``<top>/v=.../id=...`` by path below the root."""
        return [f"{top}/{v}/{i}" for v in self.storage.names(f"{self.root}/{top}", "v=") for i in self.storage.names(f"{self.root}/{top}/{v}", "id=")]

    def _store_folders(self) -> list[str]:
        return [f for t in self.storage.names(f"{self.root}/stores") for f in self._versions(f"stores/{t}")]

    def _member_folders(self) -> list[str]:
        return [
            f"{v}/{t}/{r}" for v in self._versions("membership")
            for t in self.storage.names(f"{self.root}/{v}", "type=") for r in self.storage.names(f"{self.root}/{v}/{t}", "run_id=")
        ]

    def _report_files(self) -> list[str]:
        return [n for n in self.storage.names(f"{self.root}/reports", "report_") if re.fullmatch(r"report_\d+(_job_\d+)?\.csv", n)]

    def _folders(self) -> DataFrame:
        """Store and membership folders and report files, as ``file``: a row per version, run and report."""
        names = [*self._store_folders(), *self._member_folders(), *self._report_files()]
        return self.spark.createDataFrame([(n,) for n in names], "file string")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove stores, buckets, memberships, run lists, indexes and commits that the newest ``keep`` commits do not name.

        Work folders of merges go too, so none may be under way.  Segments of a run's current fetch
        stay, since a late page merges its whole fetch again.  Returns the folders that went.
        """
        commits = sorted(int(n.removeprefix("commit=")) for n in self.storage.names(f"{self.root}/manifest", "commit="))
        kept = commits[-max(keep, 1):]
        rows = self.spark.read.schema(MANIFEST_SCHEMA + ", commit bigint").json(f"{self.root}/manifest").where(F.col("commit").isin(kept))
        named = {r["path"] for r in rows.where("path is not null").select("path").distinct().collect()}
        buckets = rows.where("kind = 'store'").select(F.explode("buckets").alias("b")).select("b.path", "b.bucket").distinct().collect()
        live = {f"{r['path']}/{BUCKET}={r['bucket']}" for r in buckets}
        named |= {r["path"] for r in buckets}
        # A membership goes by run; what else its version wrote goes with the last of its runs.
        versions = {p.partition("/type=")[0] for p in named if p.startswith("membership/")}
        named |= versions | {p.replace("membership/", "runs/", 1) for p in versions}
        found = [*self._store_folders(), *(f for top in ("membership", "runs", "attachment_index") for f in self._versions(top))]
        gone = [f for f in found if f not in named]
        # A version stays as long as one of its buckets is in use; the others go.
        gone += [
            f"{f}/{form}/{b}" for f in self._store_folders() if f in named for form in ("records", "columns")
            for b in self.storage.names(f"{self.root}/{f}/{form}", f"{BUCKET}=") if f"{f}/{b}" not in live
        ]
        # So do fetches that a newer one replaced, as they are never merged again.
        replaced = rows.where(F.col("superseded") & (F.col("commit") == kept[-1])).select("type", "fetch", "run_id").collect()
        gone += [p for r in replaced if self.storage.exists(f"{self.root}/{(p := f'segments/{r.type}/fetch={r.fetch}/run_id={r.run_id}')}")]
        gone += [f for f in self._member_folders() if f not in named and f.partition("/type=")[0] in versions]
        gone += [f"staging/{t}" for t in self.storage.names(f"{self.root}/staging")] + [f"manifest/commit={c}" for c in commits if c not in kept]
        for folder in gone:
            self.storage.delete(f"{self.root}/{folder}")
        return gone

    # ---- recovery ------------------------------------------------------------------

    def reindex(self) -> None:
        """Rebuild the manifest from the files alone.

        A store version counts if its records, membership and run list are complete.  The newest of
        them is adopted (D14), and of each run the newest membership up to it, be it empty.  Fetches on
        disk whose run is in no run list wait for a merge.  Report types come from CSV shape (B5), what an
        earlier manifest still knows is carried over (C10), and the attachment index is built anew.
        """
        try:
            commit, prior = self._entries()
        except FileNotFoundError:
            commit, prior = 0, []
        whole = self._complete_versions({e["path"] for e in prior if e["kind"] == "store"})
        versions = self.spark.createDataFrame([(t, v) for t, v in whole], "type string, version bigint")
        adopted = {r["type"]: r["version"] for r in newest_committed(versions, versions, ["type"]).where("version > 0").collect()}
        newest: dict[tuple[str, int], tuple[int, str]] = {}
        for (t, v), own in sorted(whole.items()):
            if v <= adopted[t]:
                for r in self._read_list(f"runs/v={v}_{t}/{own}"):
                    newest[t, r["run_id"]] = (v, f"membership/v={v}_{t}/{own}/type={t}/run_id={r['run_id']}")
        csvs = self._report_files()

        entries = [e for e in prior if e["kind"] in ("dataset", "attachments", "segment")] or [
            {"kind": "dataset", "name": self.root.rsplit("/", 1)[-1], "created_at": _now()}
        ]
        entries += self._fetches_on_disk(prior, newest)
        for t, v in sorted(adopted.items()):
            entries.append(self._found_store(t, v, f"stores/{t}/v={v}/{whole[t, v]}"))
        rebuilt = []
        for (t, run), (v, path) in sorted(newest.items()):
            count = self.spark.read.schema("type string").json(f"{self.root}/{path}").count() if self.storage.exists(f"{self.root}/{path}") else 0
            entries.append({"kind": "membership", "type": t, "run_id": run, "version": v, "path": path, "count": count})
            rebuilt.append({"kind": "download", "type": t, "run_id": run, "complete": True, "recovered": True, "fetched_at": _now()})
        known = {(e["type"], e["run_id"], e["job_id"]): e for e in prior if e["kind"] == "download"}
        for name in csvs:
            rebuilt.append(self._recover_csv(name, known))
        carried = self._carry(rebuilt, [e for e in prior if e["kind"] == "download"])
        entries += carried + [e for e in prior if e["kind"] == "download" and e["type"] == "attachments"]
        self._commit(entries, commit + 1)
        if adopted and (self.storage.exists(f"{self.root}/attachments") or any(e["kind"] == "attachments" for e in entries)):
            self.index_attachments()

    def _found_store(self, record_type: str, version: int, path: str) -> dict[str, Any]:
        """The entry of a complete version, from its list of buckets and their kinds."""
        rows = self._read_list(f"{path}/buckets")
        layouts: list[dict[str, str]] = []
        for r in rows:
            if r["types"] not in layouts:
                layouts.append(r["types"])
        buckets = [{"bucket": r["bucket"], "path": r["path"], "layout": layouts.index(r["types"])} for r in rows]
        live = {b["bucket"]: b for b in buckets}
        kinds = column_kinds(self.spark, {b: f"{self.root}/{e['path']}" for b, e in live.items()})
        return {
            "kind": "store", "type": record_type, "version": version, "path": path, "count": self._records(live, list(live)).count() if live else 0,
            "columns": {c: t for c, (t, _) in kinds.items()}, "buckets": buckets, "layouts": layouts,
        }

    def _complete_versions(self, named: set[str]) -> dict[tuple[str, int], str]:
        """The folder id of every version whose store, membership and run list were written to the end.

        Of several with one number (a writer died before it could clear away what it lost), that which a
        manifest names counts, else the latest.
        """
        found: dict[tuple[str, int], tuple[bool, int, str]] = {}
        for path in self._store_folders():
            _, record_type, version, own = path.split("/")
            v = int(version.removeprefix("v="))
            lists = (f"runs/v={v}_{record_type}/{own}/list.json", f"{path}/buckets/list.json")
            parts = (f"{path}/records/_SUCCESS", f"membership/v={v}_{record_type}/{own}/_SUCCESS", *lists)
            if all(self.storage.exists(f"{self.root}/{p}") for p in parts):
                rank = (path in named, self.storage.modified(f"{self.root}/{lists[0]}"), own)
                found[record_type, v] = max(found.get((record_type, v), (False, 0, "")), rank)
        return {key: own for key, (_, _, own) in found.items()}

    def _fetches_on_disk(self, prior, newest) -> list[dict[str, Any]]:
        """Segments no manifest knows; they wait for a merge unless their run was merged."""
        known = {(e["type"], e["run_id"], e["fetch"]) for e in prior if e["kind"] == "segment"}
        entries = []
        for t in self.storage.names(f"{self.root}/segments"):
            for fetch in self.storage.names(f"{self.root}/segments/{t}", "fetch="):
                for run in self.storage.names(f"{self.root}/segments/{t}/{fetch}", "run_id="):
                    run_id = int(run.removeprefix("run_id="))
                    if (t, run_id, fetch.removeprefix("fetch=")) not in known:
                        merged_as, name = newest.get((t, run_id), (None,))[0], fetch.removeprefix("fetch=")
                        held = self._batches(t, run_id, name) if merged_as is not None else None
                        entries.append({"kind": "segment", "type": t, "run_id": run_id, "fetch": name, "merged_as": merged_as, "batches": held})
        # Of several fetches of a run the last by name is the current one; numbers count as numbers.
        for e in entries:
            last = max((x["fetch"] for x in [*entries, *prior] if _is(x, "segment", e["type"], e["run_id"])), key=natural_key)
            e["superseded"] = e["fetch"] != last
            e["sequence"] = sum(natural_key(x["fetch"]) <= natural_key(e["fetch"]) for x in entries if _is(x, "segment", e["type"], e["run_id"]))
        return entries

    def _recover_csv(self, name: str, known: Mapping[tuple, Mapping[str, Any]]) -> dict[str, Any]:
        stem = name[len("report_") : -len(".csv")]
        run, _, job = stem.partition("_job_")
        run_id, job_id = int(run), int(job) if job else None
        kind = "report" if job_id is None else "report_job"
        prior = known.get((kind, run_id, job_id))
        if prior and not prior["recovered"] and prior["report_type"]:
            report_type, recovered = prior["report_type"], False
        else:
            report_type, recovered = recover_report_type(read_cells(self.spark, f"{self.root}/reports/{name}")).head()
        return {
            "kind": "download", "type": kind, "run_id": run_id, "job_id": job_id, "report_type": report_type,
            "recovered": recovered, "files": [f"reports/{name}"], "complete": True, "fetched_at": _now(),
            **self._describe_csv(f"reports/{name}", report_type),
        }

    def _carry(self, rebuilt: list[dict[str, Any]], prior: list[dict[str, Any]]) -> list[dict[str, Any]]:
        if not rebuilt or not prior:
            return rebuilt
        schema = T._parse_datatype_string(MANIFEST_SCHEMA)

        def frame(entries):
            return self.spark.createDataFrame([tuple(e.get(f.name) for f in schema.fields) for e in entries], schema)

        rows = carry_provenance(frame(rebuilt), frame(prior)).collect()
        return [r.asDict(recursive=True) for r in rows]


def list_datasets(spark: SparkSession, roots: Sequence[str], now: Column | None = None) -> DataFrame:
    """One row per dataset folder, from each one's newest manifest, by ``ref``."""
    found = [Dataset(spark, root) for root in roots]
    if not found:
        raise ValueError("no dataset folders given")
    rows = [ds.manifest().withColumn("ref", F.lit(ds.root)) for ds in found]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    stores = every.where("kind = 'store'").select("ref", "type", "count")
    attachments = every.where("kind = 'attachments'").select("ref", F.lit("attachments").alias("type"), "count")
    totals = dataset_totals(stores.unionByName(attachments), every.where("kind = 'download'"), every.where(F.lit(False)), by=["ref"])
    sizes = spark.createDataFrame([(ds.root, ds.storage.size(ds.root)) for ds in found], "ref string, size bigint")
    return dataset_listing(every.where("kind = 'dataset'").select("ref", "name", "created_at"), totals, sizes, F.current_timestamp() if now is None else now)


@cache
def _fields() -> tuple[str, ...]:
    return tuple(T._parse_datatype_string(MANIFEST_SCHEMA).names)


def natural_key(name: str) -> list[tuple[int, str]]:
    """A sort key of names in which runs of digits count as numbers."""
    return [(int(part), "") if part.isdigit() else (-1, part) for part in re.findall(r"[0-9]+|[^0-9]+", name)]


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(microsecond=0)


def _is(entry: Mapping[str, Any], kind: str, record_type: str, run_id: int) -> bool:
    return entry["kind"] == kind and entry.get("type") == record_type and entry.get("run_id") == run_id


def _upsert(entries: Sequence[Mapping[str, Any]], entry: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    def same(e):
        return _is(e, "download", entry["type"], entry["run_id"]) and e.get("job_id") == entry.get("job_id")

    return [e for e in entries if not same(e)] + [entry]
