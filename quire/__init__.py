"""quire: document-page processing on Spark.

Files are catalogued per tenant, split into pages, annotated in parallel, tracked through an
append-only change log and assembled into one result per document. Everything is a DataFrame
plan (batch) or a Structured Streaming query; nothing runs outside Spark tasks except small
per-batch helpers.

Subpackages
-----------
functions   native Column expressions (JSON truth rules, keys, routing, lifecycle)
sources     readers and writers (binaryFile/text catalogue, manifests, event streams)
operators   table operators (pages, annotation, manifest, log fold, views, publishing)
plans       the queries run against the driver's tables, with their DuckDB oracles
streaming   Structured Streaming forms (intake, completion trigger, error alarm)
"""

from quire.session import build_session, ensure_session_conf, checkpoint_root
from quire.flows import (
    accept_uploads, complete_documents, job_results, job_status, process_documents, tenant_jobs,
)

__all__ = [
    "build_session", "ensure_session_conf", "checkpoint_root",
    "accept_uploads", "process_documents", "complete_documents",
    "job_status", "job_results", "tenant_jobs",
]
