"""Registry of the queries run against the driver's tables and their DuckDB oracles."""

from __future__ import annotations

from quire.plans import kept
from quire.plans import queries as q
from quire.plans.oracle import oracle_sql

QUERIES = {
    "documents_manifest": q.q_documents_manifest,
    "split_pages": q.q_split_pages,
    "page_prompt": q.q_page_prompt,
    "annotate_pages": q.q_annotate_pages,
    "parse_reply": q.q_parse_reply,
    "document_manifest": q.q_document_manifest,
    "manifest_chunks": q.q_manifest_chunks,
    "deferred_documents": q.q_deferred_documents,
    "ready_documents": q.q_ready_documents,
    "status_fold": q.q_status_fold,
    "change_images": q.q_change_images,
    "completion_transition": q.q_completion_transition,
    "file_catalog_route": q.q_file_catalog_route,
    "upload_validation": q.q_upload_validation,
    "missing_files": q.q_missing_files,
    "retention_actions": q.q_retention_actions,
    "tenant_recent_50": q.q_tenant_recent_50,
    "tenant_documents": q.q_tenant_documents,
    "job_view": q.q_job_view,
    "results_available": q.q_results_available,
    "single_table": q.q_single_table,
    "event_envelope": q.q_event_envelope,
    "chunk_batches": q.q_chunk_batches,
    "publish_report": q.q_publish_report,
    "error_alarm": q.q_error_alarm,
    "stream_completion": q.q_stream_completion,
    "stream_error_alarm": q.q_stream_error_alarm,
    "stream_event_intake": q.q_stream_event_intake,
    "document_lifecycle": q.q_document_lifecycle,
    "chunk_fanout": q.q_chunk_fanout,
    "stream_chunk_fanout": q.q_stream_chunk_fanout,
    "ready_documents_compat": q.q_ready_documents_compat,
    "tenant_documents_compat": q.q_tenant_documents_compat,
    "result_round_trip": q.q_result_round_trip,
    "replayed_progress": q.q_replayed_progress,
    "annotate_callable": q.q_annotate_callable,
    "failed_documents": q.q_failed_documents,
    "upload_ids": q.q_upload_ids,
    "point_get": q.q_point_get,
    "stream_change_images": kept.q_stream_change_images,
    "status_fold_incremental": kept.q_status_fold_incremental,
    "tenant_recent_maintained": kept.q_tenant_recent_maintained,
    "point_get_keys": kept.q_point_get_keys,
    "result_commits": kept.q_result_commits,
    "annotate_resumable": kept.q_annotate_resumable,
    "publish_retries": kept.q_publish_retries,
    "alarm_transitions": kept.q_alarm_transitions,
    "stream_alarm_transitions": kept.q_stream_alarm_transitions,
    "retention_applied": kept.q_retention_applied,
    "split_pages_large": kept.q_split_pages_large,
}

ORACLE = oracle_sql()
# The streamed forms must agree with their batch forms.
ORACLE["stream_completion"] = ORACLE["ready_documents"]
ORACLE["stream_error_alarm"] = ORACLE["error_alarm"]
ORACLE["stream_event_intake"] = ORACLE["event_envelope"]
ORACLE["stream_chunk_fanout"] = ORACLE["chunk_fanout"]
