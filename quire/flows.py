"""The three entry flows of the reference as DataFrame functions.

1. ``accept_uploads``     validate, catalogue, open a status record, emit upload events for the
                          asynchronous route (both routes share one plan: the route is a column)
2. ``process_documents``  split into pages, spread, annotate (native or any callable), and emit
                          page rows plus the progress log (status, total, page completions)
3. ``complete_documents`` fold progress, pick ready documents, guard page counts, assemble
                          manifests and the status changes that close, fail or defer each one

plus the read side (``job_status``, ``job_results``, ``tenant_jobs``). Each step only composes
the operators in ``quire.operators``; nothing here collects to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.lifecycle import (
    DEFAULT_BUCKET, DEFAULT_THRESHOLD_MB, WRITER_TTL_DAYS, iso_utc, ttl_stamp,
)
from quire.operators.annotate import annotate_native, annotate_with
from quire.operators.catalog import catalog_files, file_id_for, validate_uploads
from quire.operators.log import document_progress
from quire.operators.manifest import current_pages, guard, manifest_parts
from quire.operators.pages import document_errors, split_pages, spread_pages
from quire.operators.publish import UPLOADED, envelope, typed_map
from quire.operators.spread import semi_spread
from quire.operators.views import job_view, tenant_recent

class Uploaded(NamedTuple):
    files: DataFrame        # D1 file records
    status_log: DataFrame   # one ``put`` per document: pending, counters 0
    rejected: DataFrame     # invalid requests with their reason
    events: DataFrame       # (key, value) upload events for the asynchronous route


class Processed(NamedTuple):
    pages: DataFrame         # D3 page rows with their analysis
    progress_log: DataFrame  # (file_id, ts, seq, page, total, status)
    failed: DataFrame        # documents that could not be split (status failed)


class Completed(NamedTuple):
    manifests: DataFrame       # D8 headers of assembled documents (counts, result key)
    chunks: DataFrame          # their chunks, one row per page (nest with nest_manifest)
    status_updates: DataFrame  # (file_id, overall_status, completed_at, result_key, error)
    deferred: DataFrame        # ready documents still missing page rows
    aggregating: DataFrame     # (file_id, overall_status, updated_at): set while assembling


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def accept_uploads(uploads: DataFrame, now, threshold_mb=DEFAULT_THRESHOLD_MB,
                   default_bucket: str = DEFAULT_BUCKET, carry: tuple[str, ...] = ()
                   ) -> Uploaded:
    """Flow 1. ``uploads``: tenant_id, file_name, file_size, has_file, optional file_id,
    request_id, mime_type and bucket. Missing ids are derived deterministically from tenant,
    name, time, size and request id (identical requests are one upload).
    ``carry`` keeps request columns (e.g. the body) on the file records for the next flow.
    """
    t = _ts(now)
    v = validate_uploads(uploads.withColumn("uploaded_at", t), "has_file", "tenant_id")
    if "file_id" not in uploads.columns:
        more = [c for c in ("file_size", "request_id") if c in uploads.columns]
        v = v.withColumn("file_id", file_id_for("tenant_id", "file_name", "uploaded_at", *more))
    ok = v.filter("valid")
    rejected = v.filter(~F.col("valid")).select("file_id", "tenant_id", "file_name",
                                                "reject_reason")
    files_all = catalog_files(ok, t, threshold_mb, default_bucket, carry=carry)
    files = files_all.drop(*carry)
    fields = F.create_map(
        F.lit("tenant_id"), F.col("tenant_id"), F.lit("overall_status"), F.lit("pending"),
        F.lit("total_pages"), F.lit("0"), F.lit("processed_pages"), F.lit("0"),
        F.lit("failed_pages"), F.lit("0"), F.lit("started_at"), iso_utc(t))
    status_log = files.select("file_id", t.alias("ts"), F.lit(0).cast("long").alias("seq"),
                              F.lit("put").alias("op"), fields.alias("fields"),
                              F.lit(None).cast("long").alias("inc"))
    data = typed_map(fileId=F.col("file_id"), tenantId=F.col("tenant_id"),
                     fileName=F.col("file_name"), fileSize=F.col("file_size"),
                     s3Key=F.col("s3_key"), bucket=F.col("s3_bucket"))
    events = (files.filter(F.col("processing_type") == "async")
              .select(F.col("tenant_id").alias("key"),
                      envelope(F.lit(UPLOADED), data, t).alias("value")))
    return Uploaded(files_all if carry else files, status_log, rejected, events)


def process_documents(docs: DataFrame, now, annotator: Callable[[str], str] | None = None,
                      sep: str = "\n", partitions: int | None = None,
                      ttl_days: int = WRITER_TTL_DAYS,
                      annotator_options: dict | None = None) -> Processed:
    """Flow 2. ``docs``: file_id, tenant_id, text. Pages are spread over ``partitions`` tasks
    before annotation (see ``spread_pages``); every page is stored (a failed annotation stores the
    placeholder) and counts as processed. ``annotator_options`` go to ``annotate_with``
    (retries, delay, concurrency, min_interval)."""
    t = _ts(now)
    split = split_pages(docs, "text", sep)
    pages = spread_pages(split, partitions)
    annotated = (annotate_native(pages, t) if annotator is None
                 else annotate_with(pages, annotator, t, **(annotator_options or {})))
    page_rows = annotated.select(
        "file_id", "tenant_id", "page_number", "page_text", "page_analysis",
        F.lit(None).cast("array<string>").alias("chunk_ids"),
        t.alias("created_at"), t.alias("updated_at"), ttl_stamp(t, ttl_days).alias("ttl"))
    # progress needs page counts only: per document the status, the total and a row per page,
    # without the text of any page
    none = F.lit(None).cast("int")
    counted = docs.select("file_id", F.size(F.split("text", sep, -1)).alias("n")).filter("n > 0")
    step = F.col("seq") - 1
    progress = (counted.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") + 1))
                               .alias("seq"))
                .select("file_id", t.alias("ts"), F.col("seq").cast("long").alias("seq"),
                        F.when(step > 0, step).otherwise(none).alias("page"),
                        F.when(step == 0, F.col("n")).otherwise(none).alias("total"),
                        F.when(step < 0, F.lit("processing")).alias("status")))
    failed = document_errors(docs)
    return Processed(page_rows, progress, failed)


def complete_documents(progress_log: DataFrame, pages: DataFrame, processed_at,
                       dedupe_pages: bool = True) -> Completed:
    """Flow 3. Ready documents (processed = total > 0, processing) whose page rows are all
    present are assembled; a document with an unparsable page fails with a message; the rest
    are deferred and stay ready for the next run. With ``dedupe_pages`` the page table is read
    as a keyed store (last write per page wins), so replayed page writes change nothing; pass
    False when the pages are known to be one row per page."""
    t = _ts(processed_at)
    ready_docs = document_progress(progress_log).filter("ready").select("file_id",
                                                                        "total_pages")
    # only what completion reads, of the candidates: page text never travels through the dedupe
    # or the manifest, and a candidate with very many pages is matched in many places
    cols = [c for c in ("file_id", "tenant_id", "page_number", "page_analysis", "updated_at")
            if c in pages.columns]
    pages = semi_spread(pages.select(*cols), ready_docs, ["file_id"], "page_number")
    if dedupe_pages:
        pages = current_pages(pages)
    decided = guard(ready_docs, pages)
    go = decided.filter(F.col("action") == "assemble").select("file_id", "total_pages")
    # pages are reduced to one row per document before they meet the documents to assemble
    headers, chunks = manifest_parts(pages, go, t, how="inner")
    manifests = headers.filter(F.col("document_status") == "completed")
    closed = headers.select(
        "file_id", F.col("document_status").alias("overall_status"),
        F.when(F.col("document_status") == "completed", t).alias("completed_at"),
        "result_key", "error_message")
    deferred = decided.filter(F.col("action") == "deferred")
    reopened = deferred.select("file_id", F.lit("processing").alias("overall_status"),
                               F.lit(None).cast("timestamp").alias("completed_at"),
                               F.lit(None).cast("string").alias("result_key"),
                               F.lit(None).cast("string").alias("error_message"))
    done_chunks = semi_spread(chunks, manifests, ["file_id"], "page_number")
    aggregating = go.select("file_id", F.lit("aggregating").alias("overall_status"),
                            t.alias("updated_at"))
    return Completed(manifests, done_chunks, closed.unionByName(reopened), deferred, aggregating)


def job_status(status: DataFrame, files: DataFrame, file_id: str | None = None,
               tenant: str | None = None) -> DataFrame:
    """Read side: job view rows (one file, one tenant, or all)."""
    st = status if file_id is None else status.filter(F.col("file_id") == file_id)
    return job_view(st, files, tenant)


def job_results(manifests: DataFrame, file_id: str) -> DataFrame:
    """Read side: the manifest header of one document (zero or one row)."""
    return manifests.filter(F.col("file_id") == file_id)


def tenant_jobs(files: DataFrame, tenant: str, k: int = 50) -> DataFrame:
    """Read side: a tenant's newest files (four columns and rank)."""
    return tenant_recent(files, k, tenant=tenant)
