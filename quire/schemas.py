"""Explicit schemas for every table and stream the library reads or writes.

No production path infers a schema; readers pass these.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, TS, B = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BooleanType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# Fixed values of the record model (lifecycle states and routing classes).
FILE_STATES = ("uploaded", "processing", "completed", "failed")
DOC_STATES = ("pending", "chunking", "processing", "aggregating", "completed", "failed")
PROCESSING_TYPES = ("sync", "async")

# One row per uploaded file.
FILES = T.StructType([
    _f("file_id", S, False), _f("file_name", S), _f("file_size", L), _f("mime_type", S),
    _f("s3_key", S), _f("s3_bucket", S), _f("tenant_id", S), _f("user_id", S),
    _f("processing_type", S), _f("status", S), _f("uploaded_at", TS), _f("updated_at", TS),
    _f("ttl", L),
])

# One row per document (derived from the change log).
DOC_STATUS = T.StructType([
    _f("file_id", S, False), _f("tenant_id", S), _f("overall_status", S), _f("total_pages", I),
    _f("processed_pages", I), _f("failed_pages", I), _f("started_at", TS), _f("completed_at", TS),
    _f("error_message", S), _f("result_key", S), _f("created_at", TS), _f("updated_at", TS),
    _f("ttl", L),
])

# D3: one row per (document, page). page_text is ours; analysis is JSON text.
PAGES = T.StructType([
    _f("file_id", S, False), _f("tenant_id", S), _f("page_number", I, False), _f("page_text", S),
    _f("page_analysis", S), _f("chunk_ids", T.ArrayType(S)), _f("created_at", TS),
    _f("updated_at", TS), _f("ttl", L),
])

# Tenants (seed data only).
TENANTS = T.StructType([_f("tenant_id", S, False), _f("tenant_name", S), _f("created_at", TS)])

# Event envelope as it travels (JSON text in ``value``, routing key in ``key``).
EVENT_WIRE = T.StructType([_f("key", S), _f("value", S)])

# D5 after a strict parse.
EVENT_ENVELOPE = T.StructType([
    _f("event_type", S), _f("data", T.MapType(S, S)), _f("timestamp", S),
    _f("metadata", T.MapType(S, S)),
])

# D6 / change log row: one mutation of a keyed record.
#   op: put | set | inc | delete; fields: the values written by put/set (string-encoded).
LOG = T.StructType([
    _f("file_id", S, False), _f("ts", TS, False), _f("seq", L, False), _f("op", S, False),
    _f("fields", T.MapType(S, S)), _f("inc", L),
])

# Manifest, header plus ordered chunks.
CHUNK = T.StructType([_f("page_number", I), _f("analysis", S), _f("status", S)])
MANIFEST = T.StructType([
    _f("file_id", S, False), _f("tenant_id", S), _f("processed_at", S), _f("total_pages", I),
    _f("success_count", L), _f("failed_count", L), _f("missing_count", L),
    _f("invalid_count", L), _f("chunks", T.ArrayType(CHUNK)),
])

# binaryFile source columns.
BINARY_FILE = T.StructType([
    _f("path", S), _f("modificationTime", TS), _f("length", L), _f("content", T.BinaryType()),
])

# Page annotation (D7) in structured form.
ANALYSIS = T.StructType([
    _f("summary", S), _f("entities", T.ArrayType(S)), _f("keyPoints", T.ArrayType(S)),
    _f("sentiment", S),
])
