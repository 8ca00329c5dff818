"""Native Column expressions (no UDFs)."""

from quire.functions.jsonrules import (
    strict_json, truthy, error_is_truthy, page_outcome, chunk_status, reply_json_text,
    parse_reply, compact_json,
)
from quire.functions.lifecycle import (
    iso_utc, parse_float_prefix, parse_int_prefix, processing_type, or_default, ready,
    ttl_stamp, is_live, age_days, retention_action, progress_percent,
)
from quire.functions.keys import (
    file_pk, doc_pk, page_sk, file_index_keys, status_index_keys, object_key, results_key,
    chunk_partition_key, path_parts,
)

__all__ = [
    "strict_json", "truthy", "error_is_truthy", "page_outcome", "chunk_status",
    "reply_json_text", "parse_reply", "compact_json", "iso_utc", "parse_float_prefix",
    "parse_int_prefix", "processing_type", "or_default", "ready", "ttl_stamp", "is_live",
    "age_days", "retention_action", "progress_percent", "file_pk", "doc_pk", "page_sk",
    "file_index_keys", "status_index_keys", "object_key", "results_key", "chunk_partition_key",
    "path_parts",
]
