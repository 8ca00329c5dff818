"""Queries over the driver's tables, one per operator group of the survey.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame with flat scalar columns whose
names match the DuckDB oracle in ``quire.plans.oracle``. Nested forms (manifest JSON, change
images as structs) are exercised in the test suite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.flows import accept_uploads, complete_documents, process_documents
from quire.functions.jsonrules import chunk_status, with_outcome, with_parsed
from quire.functions.keys import doc_pk, file_pk, page_sk
from quire.functions.lifecycle import iso_utc, ready, ttl_stamp
from quire.operators.alarm import error_alarm
from quire.operators.annotate import (
    annotate_native, annotate_with, store_replies, with_native_analysis,
)
from quire.operators.catalog import (
    catalog_files, file_id_for, object_exists, retention, validate_uploads,
)
from quire.operators.log import (
    change_images, completion_edges, document_progress, first_completions, fold,
    modify_status_changes, page_changes, point_get, single_table,
)
from quire.operators.manifest import guard, manifest_chunks, manifest_header, manifest_parts
from quire.operators.pages import document_errors, prompt, split_pages
from quire.operators.publish import (
    chunk_events, number_in_batches, parse_envelopes, publish_report,
)
from quire.operators.views import documents_by_tenant, job_view, results_available, tenant_recent
from quire.plans.inputs import (
    annotation_fault, drilled_annotator, recorded_totals, replayed, event_tenant, events_as_log, files_from_documents, now_col,
    pages_from_conversations, progress_log, receipts_from_orders, reply_kind, status_change_log, status_from_labels,
    table, uploads_from_documents, wire_events, wrap_reply,
)
from quire.session import ensure_session_conf
from quire.sources.events import (
    DOCUMENTS, WIRE_WITH_SEQ, read_event_files, read_table_files,
)
from quire.sources.objects import read_results, write_results
from quire.streaming.alarm import final_windows, start_alarm
from quire.streaming.completion import current_status, run_folder, start_completion
from quire.streaming.intake import intake_table, start_intake


def _flat_analysis(df: DataFrame, analysis_col: str = "page_analysis") -> DataFrame:
    """Read stored analysis text back into flat columns (what a consumer of the pages sees)."""
    staged = with_parsed(df, analysis_col, "_fa_v")
    staged = with_outcome(staged, analysis_col, "outcome", parsed="_fa_v")
    v = F.col("_fa_v")
    staged = staged.withColumn("_fa_ents", F.try_variant_get(v, "$.entities", "array<string>"))
    ents = F.col("_fa_ents")
    return (staged
            .withColumn("summary", F.try_variant_get(v, "$.summary", "string"))
            .withColumn("n_entities", F.coalesce(F.size(ents), F.lit(0)).cast("long"))
            .withColumn("entities", F.array_join(F.array_sort(ents), " "))
            .withColumn("n_key_points", F.coalesce(
                F.size(F.try_variant_get(v, "$.keyPoints", "array<string>")), F.lit(0))
                .cast("long"))
            .withColumn("sentiment", F.try_variant_get(v, "$.sentiment", "string"))
            .withColumn("error", F.try_variant_get(v, "$.error", "string"))
            .drop("_fa_v", "_fa_ents"))


# ------------------------------------------------------------------ documents -> pages (M1)

def q_split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split into pages on newlines, numbered from 1, keyed PAGE#nnnn."""
    files = files_from_documents(table(spark, sf_dir, "documents"))
    pages = split_pages(files, "text", "\n", keep=("file_id", "tenant_id"))
    return pages.select("file_id", "tenant_id", "page_number",
                        page_sk("page_number").alias("page_key"),
                        "total_pages", F.length("page_text").cast("long").alias("page_chars"))


def documents_pages_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = files_from_documents(table(spark, sf_dir, "documents"))
    # spread before the split: documents are fewer rows than pages
    pages = split_pages(files.select("file_id", "tenant_id", "text").repartition("file_id"),
                        "text", "\n", keep=("file_id", "tenant_id"))
    fault = ((F.col("file_id").cast("long") * 7 + F.col("page_number")) % 11) == 0
    return annotate_native(pages, now_col(), "page_text", fail=fault)


def _length_of(v, member: str):
    """Length of an array member of a parsed analysis, 0 where there is none."""
    return F.coalesce(F.size(F.try_variant_get(v, f"$.{member}", "array<string>")),
                      F.lit(0)).cast("long")


def q_documents_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship (M1 -> M2 -> A1): documents split into pages, annotated natively (pages chosen
    by a fixed fault-drill rule on (file, page) get the failure placeholder), and reduced to one
    manifest header per document with success / failed counts."""
    pages = documents_pages_annotated(spark, sf_dir)
    # total_pages is constant per document: a grouping key, not a join back
    head = manifest_header(pages, keys=("file_id", "tenant_id", "total_pages"), totals={
        "entities": lambda v: F.sum(_length_of(v, "entities")),
        "key_points": lambda v: F.sum(_length_of(v, "keyPoints")),
        "positive_pages": lambda v: F.count_if(
            F.try_variant_get(v, "$.sentiment", "string") == "positive"),
        "negative_pages": lambda v: F.count_if(
            F.try_variant_get(v, "$.sentiment", "string") == "negative")})
    return head.select(
        "file_id", "tenant_id", F.col("total_pages").cast("long"), "pages_found",
        "success_count", "failed_count", "missing_count", "invalid_count", "document_status",
        "entities", "key_points", "positive_pages", "negative_pages")


# ------------------------------------------------------------------ conversations -> pages

def q_page_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3 F1: the annotation prompt around each page's text."""
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    p = prompt("page_text")
    return pages.select("file_id", "page_number", F.length(p).cast("long").alias("prompt_chars"),
                        F.md5(p).alias("prompt_md5"))


def conversation_pages_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    return annotate_native(pages, now_col(), "page_text",
                           fail=annotation_fault("conv_id", "turn"))


def q_annotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 M6: native annotation of every page; faulted pages get the failure placeholder and
    are still present."""
    pages = _flat_analysis(conversation_pages_annotated(spark, sf_dir))
    return pages.select("file_id", "page_number", page_sk("page_number").alias("page_key"),
                        chunk_status("outcome").alias("chunk_status"), "summary",
                        "n_entities", "entities", "n_key_points", "sentiment", "error")


def conversation_pages_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored after a model round trip: the native analysis travels as a reply of one
    of eight shapes, is cut and strictly parsed (M4), and the result or the placeholder is
    stored. System turns store no analysis."""
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    replies = (with_native_analysis(pages, "page_text", "_analysis")
               .withColumn("_analysis_json", F.to_json("_analysis"))
               .withColumn("reply_kind", reply_kind("conv_id", "turn")))
    replies = replies.withColumn("reply", wrap_reply(F.col("reply_kind"), F.col("_analysis_json")))
    stored = store_replies(replies, "reply", now_col(), out="_stored")
    return (stored.withColumn("page_analysis", F.when(F.col("role") == "system", F.lit(None)
                                                      .cast("string")).otherwise(F.col("_stored")))
            .drop("_analysis", "_analysis_json", "reply", "_stored"))


def q_parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cut to their JSON and strictly parsed; rejected replies become the
    failure placeholder."""
    pages = _flat_analysis(conversation_pages_stored(spark, sf_dir))
    return pages.select("file_id", "page_number", "reply_kind", "outcome", "summary",
                        "n_entities", "sentiment", "error")


def q_document_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest header per document over its stored pages."""
    pages = conversation_pages_stored(spark, sf_dir)
    return manifest_header(pages, keys=("file_id", "tenant_id")).select(
        "file_id", "tenant_id", "pages_found", "success_count", "failed_count",
        "missing_count", "invalid_count", "document_status", "error_message")


def q_manifest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's chunk list, one row per page in numeric page order."""
    pages = conversation_pages_stored(spark, sf_dir)
    ch = manifest_chunks(pages, keys=("file_id", "tenant_id"))
    return ch.select("file_id", "tenant_id", "page_number", "page_key", "outcome",
                     "chunk_status", F.col("analysis").isNotNull().alias("has_analysis"),
                     F.get_json_object("analysis", "$.summary").alias("summary"),
                     F.coalesce(F.json_array_length(F.get_json_object("analysis", "$.entities")),
                                F.lit(0)).cast("long").alias("n_entities"))


def q_deferred_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 ST4: documents whose stored pages are fewer than their recorded total are deferred.

    Totals are recorded at split time; for some documents one more page is recorded than is
    stored yet (``recorded_totals``), so those must wait."""
    stored = pages_from_conversations(table(spark, sf_dir, "conversations"))
    return guard(recorded_totals(stored), stored).select("file_id", F.col("total_pages").cast("long"),
                                        "pages_found", "action")


# ------------------------------------------------------------------ events -> change log

def q_ready_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ready for aggregation (processed = total > 0, status processing);
    processed counts distinct finished pages, so replays do not over-count."""
    prog = document_progress(progress_log(table(spark, sf_dir, "events")))
    return prog.filter("ready").select("file_id", "processed_pages", "total_pages",
                                       "overall_status")


def q_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status table as a fold of its change log (put / set / increment /
    delete), one row per live document."""
    log = status_change_log(table(spark, sf_dir, "events"))
    st = fold(log, fields=("tenant_id", "overall_status", "total_pages", "error_message"),
              counter="processed_pages")
    return st.select(
        "file_id", "tenant_id", "overall_status",
        F.col("total_pages").cast("long").alias("total_pages"),
        F.col("processed_pages").cast("long").alias("processed_pages"), "error_message",
        iso_utc("created_at").alias("created_at"), iso_utc("updated_at").alias("updated_at"),
        F.col("ops").cast("long").alias("ops"),
        ready(F.col("processed_pages"), F.col("total_pages").cast("long"),
              F.col("overall_status")).alias("ready"))


def _status_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = progress_log(table(spark, sf_dir, "events"))
    marked = first_completions(log)
    images = change_images(log, marked=marked)
    pages = page_changes(log, marked=marked)
    return single_table(status=images, page=pages)


def q_change_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 ST2 P7: old and new image of the status record at each change; the feed also holds
    page-record changes, filtered out with INSERTs, as the completion trigger sees it."""
    feed = modify_status_changes(_status_feed(spark, sf_dir))
    return feed.select(
        "file_id", "seq", iso_utc("ts").alias("ts"), "old_processed", "old_total", "old_status",
        "new_processed", "new_total", "new_status",
        ready("new_processed", "new_total", "new_status").alias("level_trigger"))


def q_completion_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: the changes at which a document becomes ready (ready now, not before), over the
    status-record changes of the log."""
    feed = modify_status_changes(change_images(progress_log(table(spark, sf_dir, "events"))))
    edges = completion_edges(feed)
    return edges.select("file_id", "seq", iso_utc("ts").alias("ts"), "new_processed",
                        "new_total")


# ------------------------------------------------------------------ catalogue and views

ROUTE_THRESHOLD_MB = "0.00390625"   # 4,096 bytes: splits the driver's documents by size


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    ups = uploads_from_documents(table(spark, sf_dir, "documents"))
    return catalog_files(ups, now_col(), threshold_mb=ROUTE_THRESHOLD_MB)


def q_file_catalog_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records with keys, object key, default bucket, size routing
    (inclusive threshold) and retention stamp."""
    cat = _catalog(spark, sf_dir)
    return cat.select("file_id", "tenant_id", "pk", "sk", "gsi1pk", "gsi1sk", "s3_key",
                      "s3_bucket", "processing_type", "status", "ttl")


def q_upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload requests validated in order (file part, then non-empty tenant)."""
    ups = uploads_from_documents(table(spark, sf_dir, "documents"))
    v = validate_uploads(ups, "has_file", "form_tenant")
    return v.select("file_id", "valid", "reject_reason")


def q_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: existence of each catalogued file's object against a listing (labels hold the
    stored objects)."""
    cat = _catalog(spark, sf_dir)
    listing = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string")
                                                    .alias("file_id"))
    return object_exists(cat, listing).select("file_id", "s3_key", "exists")


def q_retention_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file, document expiry at 90 days, result archive at 30 days (results are
    written a day after upload), and whether the record's ttl is still live at NOW."""
    cat = _catalog(spark, sf_dir)
    # ttl as the writers stamp it: 90 days from the upload time
    cat = cat.withColumn("ttl", ttl_stamp(F.col("uploaded_at")))
    r = retention(cat, now_col(), result_lag_days=1)
    return r.select("file_id", "age_days", "document_action", "result_age_days",
                    "result_action", "ttl", "live")


def q_tenant_recent_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest files of every tenant, newest first, ties by file id."""
    cat = _catalog(spark, sf_dir)
    top = tenant_recent(cat, 50)
    return top.select("tenant_id", F.col("rank").cast("long").alias("rank"), "file_id",
                      "file_name", "status", iso_utc("uploaded_at").alias("uploaded_at"))


def q_tenant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most recently updated documents of every tenant from the folded status
    table (ties by file id)."""
    log = status_change_log(table(spark, sf_dir, "events"))
    st = fold(log, fields=("tenant_id", "overall_status"), counter=None)
    top = documents_by_tenant(st, 50)
    return top.select("tenant_id", F.col("rank").cast("long").alias("rank"), "file_id",
                      "overall_status", iso_utc("created_at").alias("created_at"),
                      iso_utc("updated_at").alias("updated_at"))


def q_job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job view per status row, left-joined to file records, flattened."""
    status = status_from_labels(table(spark, sf_dir, "labels"))
    files = files_from_documents(table(spark, sf_dir, "documents"))
    v = job_view(status, files)
    return v.select("file_id", "file_name", "status",
                    F.col("progress.processed").cast("long").alias("processed"),
                    F.col("progress.total").cast("long").alias("total"),
                    F.col("progress.failed").cast("long").alias("failed"),
                    F.col("timestamps.uploaded").alias("uploaded"),
                    F.col("timestamps.started").alias("started"),
                    F.col("timestamps.completed").alias("completed"),
                    F.col("result.s3_key").alias("result_s3_key"), "percent")


def q_results_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with ``available``: its status row carries a result key. The keys are
    de-duplicated and joined once (left outer) instead of a semi and an anti join."""
    files = files_from_documents(table(spark, sf_dir, "documents"))
    status = status_from_labels(table(spark, sf_dir, "labels"))
    return results_available(files.select("file_id", "tenant_id"), status).select(
        "file_id", "tenant_id", "available")


def q_single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records and page records in one table, told apart by key prefix."""
    files = files_from_documents(table(spark, sf_dir, "documents")).select(
        file_pk("file_id").alias("pk"), F.lit("METADATA").alias("sk"), "tenant_id", "file_name")
    pages = pages_from_conversations(table(spark, sf_dir, "conversations")).select(
        doc_pk("file_id").alias("pk"), page_sk("page_number").alias("sk"), "tenant_id",
        "page_number")
    t = single_table(file=files, page=pages)
    return t.select("pk", "sk", "kind", "tenant_id", "file_name", "page_number",
                    F.col("sk").startswith("PAGE#").alias("is_page"))


# ------------------------------------------------------------------ events, batches, alarms

def _with_page_type(parsed: DataFrame) -> DataFrame:
    """The JSON type a page number travelled with (null where there is none)."""
    page = F.try_variant_get(F.try_parse_json("value"), "$.data.pageNumber", "variant")
    return parsed.withColumn("page_number_type", F.when(
        F.col("disposition") != "quarantine", F.schema_of_variant(page)))


def q_event_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes built (payload merged over fileId/tenantId, later keys win),
    then taken in: strict parse, uploads processed, others ignored, broken ones quarantined,
    empty bucket replaced by the default."""
    wire = wire_events(table(spark, sf_dir, "events"))
    parsed = parse_envelopes(wire, typed_fields=("pageNumber",))
    return parsed.select(
        "seq", "key", "event_type", "disposition", "file_id", "tenant_id", "s3_key", "bucket",
        F.col("pageNumber_type").alias("page_number_type"))


def q_chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunks (lineitem rows of a supplier) in order, split into
    publish batches of 500."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("document"), "l_orderkey", "l_linenumber", "l_partkey",
        "l_shipdate", "l_extendedprice")
    b = number_in_batches(li, "document",
                          ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
                           "l_extendedprice"])
    return b.select("document", "l_orderkey", "l_linenumber", "l_partkey", "chunk_index",
                    "batch_id", "batch_index")


def q_publish_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's events in publish batches of 500; the transport's receipts (rows
    of orders), numbered in the order they came, are matched by batch position and totalled per
    batch. A record without a receipt counts as accepted."""
    log = events_as_log(table(spark, sf_dir, "events")).withColumn(
        "tenant_id", event_tenant("user_id"))
    recs = number_in_batches(log.select("tenant_id", "ts", "seq"), "tenant_id", ["ts", "seq"])
    outcomes = number_in_batches(receipts_from_orders(table(spark, sf_dir, "orders")),
                                 "tenant_id", ["o_orderkey"])
    totals, _failed = publish_report(recs, outcomes, ["tenant_id"])
    return totals.select("tenant_id", "batch_id", "records", "success_count", "failed_count",
                         "error")


def q_error_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: error events per tumbling 6-hour window, alarm when strictly above 10 (the deployed
    5-minute rule never fires on this data; it is covered by tests)."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return error_alarm(ev, "ts", "6 hours", 10).select("window_start", "window_end", "metric",
                                                       "alarm")


# ------------------------------------------------------------------ streaming

def _state_partitions(spark: SparkSession) -> int | None:
    """One state partition per core of the cluster (fixed at the first start)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - remote session: keep the session's setting
        return None


def q_stream_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 ST1 ST3 ST6: the events table read as a file stream (availableNow), per-document
    progress kept in streaming state, updates written exactly once per batch; result: the
    documents whose latest state is ready (same as ``ready_documents``)."""
    events = read_table_files(spark, sf_dir, "events")
    out = run_folder(spark, "stream_completion")
    q = start_completion(progress_log(events), out, f"{out}/_checkpoint",
                         state_partitions=_state_partitions(spark))
    q.awaitTermination()
    st = current_status(spark, out)
    return st.filter("ready").select("file_id", "processed_pages", "total_pages",
                                     "overall_status")


def q_stream_error_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 A5: error events per 6-hour window from the event stream (no row is too late), last
    update per window, alarm when above 10."""
    events = read_table_files(spark, sf_dir, "events")
    errors = events.filter(F.col("event_type") == "error")
    out = run_folder(spark, "stream_error_alarm")
    q = start_alarm(errors, out, f"{out}/_checkpoint", period="6 hours",
                    state_partitions=_state_partitions(spark))
    q.awaitTermination()
    w = final_windows(spark, out)
    return w.select(iso_utc("window_start_ts").alias("window_start"),
                    iso_utc("window_end_ts").alias("window_end"), "metric",
                    (F.col("metric") > 10).alias("alarm"))


def q_stream_event_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 P4 P5 S8: envelopes built from the events table are published as JSON-line files
    (the transport, with its sequence number), read back as a stream and taken in: strict
    parse, uploads processed, others ignored, broken ones quarantined (same result as
    ``event_envelope``)."""
    out = run_folder(spark, "stream_event_intake")
    wire_events(table(spark, sf_dir, "events")).write.json(f"{out}/wire")
    stream = read_event_files(spark, f"{out}/wire", schema=WIRE_WITH_SEQ, fmt="json")
    start_intake(stream, out, f"{out}/_checkpoint").awaitTermination()
    return _with_page_type(intake_table(spark, out)).select(
        "seq", "key", "event_type", "disposition", "file_id", "tenant_id", "s3_key", "bucket",
        "page_number_type")


# ------------------------------------------------------------------ the three flows together

def q_document_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload -> process -> complete over every document: requests validated and routed
    (invalid ones rejected), accepted documents split, annotated natively and tracked in the
    progress log, then folded, guarded and assembled into one manifest each."""
    ups = uploads_from_documents(table(spark, sf_dir, "documents"))
    requests = ups.select("file_id", F.col("form_tenant").alias("tenant_id"), "file_name",
                          "file_size", "has_file", "bucket", "text")
    # the body travels with the accepted request (no join back to the documents)
    up = accept_uploads(requests, now_col(), threshold_mb=ROUTE_THRESHOLD_MB, carry=("text",))
    docs = up.files.select("file_id", "tenant_id", "text")
    pr = process_documents(docs, now_col())
    # the page table is written once (shared folder), as a page store would be; completion then
    # reads the columns it needs instead of re-annotating for each of its uses
    store = f"{run_folder(spark, 'document_lifecycle')}/pages"
    pr.pages.write.parquet(store)
    pages = spark.read.parquet(store)
    # one processing run: exactly one row per page, no replays to collapse
    done = complete_documents(pr.progress_log, pages, now_col(), dedupe_pages=False)
    # what the stored analyses of the assembled documents say
    said = pages.groupBy("file_id").agg(F.sum(F.json_array_length(
        F.get_json_object("page_analysis", "$.entities"))).cast("long").alias("entities"))
    return (done.manifests.join(up.files.select("file_id", "processing_type"), "file_id")
            .join(said, "file_id")
            .select("file_id", "tenant_id", "processing_type",
                    F.col("total_pages").cast("long").alias("total_pages"),
                    "success_count", "failed_count", "missing_count", "result_key", "entities"))


def q_chunk_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 S8: one chunk-ready event per page of every document (routing key tenant#file),
    taken back in by the intake parser (other event types are ignored, not processed) and
    counted per routing key with the highest page number seen."""
    files = files_from_documents(table(spark, sf_dir, "documents"))
    pages = (split_pages(files, "text", "\n", keep=("file_id", "tenant_id"))
             .select("file_id", "tenant_id", "page_number"))
    wire = chunk_events(pages, now_col())
    parsed = parse_envelopes(wire, extra_fields=("pageNumber",)).withColumn(
        "page_number", F.col("pageNumber").cast("int"))
    return parsed.groupBy("key", "file_id", "event_type", "disposition").agg(
        F.count(F.lit(1)).alias("events"), F.max("page_number").cast("long").alias("max_page"))


# ------------------------------------------------------------------ literal (compat) forms

def q_ready_documents_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 P6, literal counter: every page completion increments processed, so a repeated
    completion counts twice; a document can then pass its total and never be ready, or reach
    it before all of its pages are done."""
    prog = document_progress(progress_log(table(spark, sf_dir, "events")), compat=True)
    return prog.filter("ready").select("file_id", "processed_pages", "total_pages",
                                       "overall_status")


def q_tenant_documents_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2, literal order: the 50 documents of every tenant with the latest creation time
    (the listing's sort key is written once at creation), ties by file id."""
    log = status_change_log(table(spark, sf_dir, "events"))
    st = fold(log, fields=("tenant_id", "overall_status"), counter=None)
    top = documents_by_tenant(st, 50, compat=True)
    return top.select("tenant_id", F.col("rank").cast("long").alias("rank"), "file_id",
                      "overall_status", iso_utc("created_at").alias("created_at"),
                      iso_utc("updated_at").alias("updated_at"))


def q_stream_chunk_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5 S8 ST1: documents arrive as a file stream; each micro-batch splits them into pages
    and publishes one chunk-ready event per page (stateless, written per batch with
    overwrite); the published events are read back through the intake parser and counted per
    routing key (same result as ``chunk_fanout``)."""
    out = run_folder(spark, "stream_chunk_fanout")
    ensure_session_conf(spark)
    docs = read_table_files(spark, sf_dir, "documents", DOCUMENTS)
    pages = split_pages(files_from_documents(docs), "text", "\\n",
                        keep=("file_id", "tenant_id"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        chunk_events(batch, now_col()).write.mode("overwrite").parquet(
            f"{out}/events/batch_id={batch_id}")

    (pages.select("file_id", "tenant_id", "page_number").writeStream
     .option("checkpointLocation", f"{out}/_checkpoint").foreachBatch(publish)
     .trigger(availableNow=True).start().awaitTermination())
    wire = spark.read.parquet(f"{out}/events")
    parsed = parse_envelopes(wire, extra_fields=("pageNumber",)).withColumn(
        "page_number", F.col("pageNumber").cast("int"))
    return parsed.groupBy("key", "file_id", "event_type", "disposition").agg(
        F.count(F.lit(1)).alias("events"), F.max("page_number").cast("long").alias("max_page"))


# ------------------------------------------------------------------ stored results, failures, runs

def q_result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by two runs that share tenants, and read back. The first run stores
    every document with its failed annotations, the second annotates the documents that had one
    again; of each document the last run's result counts, all others stay as they were."""
    folder = run_folder(spark, "result_round_trip")
    totals = (pages_from_conversations(table(spark, sf_dir, "conversations")).groupBy("file_id")
              .agg(F.count(F.lit(1)).cast("int").alias("total_pages")))
    first, chunks = manifest_parts(conversation_pages_annotated(spark, sf_dir), totals, now_col())
    write_results(first, chunks, folder, run_id="1")
    failed = read_results(spark, folder)[0].filter("failed_count > 0").select("file_id")
    again = annotate_native(
        pages_from_conversations(table(spark, sf_dir, "conversations"))
        .join(failed, "file_id", "left_semi"), now_col(), "page_text")
    second, chunks = manifest_parts(again, totals, now_col(), how="inner")
    write_results(second, chunks, folder, run_id="2")
    headers, stored = read_results(spark, folder)
    pages = stored.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    return headers.join(pages, "file_id").select(
        "file_id", "tenant_id", "run_id", F.col("total_pages").cast("long").alias("total_pages"),
        "success_count", "failed_count", "chunks", "result_key")


def q_replayed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 ST3 under replay: a log whose rows come again in a second run with the same sequence
    numbers; per document the pages processed at the end, and how often it became ready."""
    log = replayed(progress_log(table(spark, sf_dir, "events")))
    images = change_images(log)
    edges = completion_edges(modify_status_changes(images)).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("transitions"))
    last = images.groupBy("file_id").agg(F.max("new_processed").alias("processed"),
                                         F.count(F.lit(1)).alias("changes"))
    return last.join(edges, "file_id", "left").select(
        "file_id", "processed", "changes",
        F.coalesce("transitions", F.lit(0)).cast("long").alias("transitions"))


def q_annotate_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's annotator gets the prompt of every page, with the rate-limit
    retries and the placeholder for what fails."""
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    done = annotate_with(pages, drilled_annotator, now_col(), delay=0.0)
    return _flat_analysis(done).select(
        "file_id", "page_number", F.col("attempts").cast("long").alias("attempts"),
        chunk_status("outcome").alias("chunk_status"), "summary", "error")


def q_failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 A1: documents that end as failed: those without a text to split, and those with a page
    whose stored analysis is not valid JSON."""
    unsplit = document_errors(files_from_documents(table(spark, sf_dir, "documents"))).select(
        "file_id", "tenant_id", "overall_status", F.lit(None).cast("string").alias("error_message"))
    heads = manifest_header(conversation_pages_stored(spark, sf_dir))
    invalid = heads.filter("document_status = 'failed'").select(
        "file_id", "tenant_id", F.col("document_status").alias("overall_status"), "error_message")
    return unsplit.unionByName(invalid)


def q_upload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ids derived from the request, the same for the same request."""
    files = files_from_documents(table(spark, sf_dir, "documents"))
    named = files.withColumn("upload_id", file_id_for("tenant_id", "file_name", "uploaded_at"))
    return named.select("file_id", "upload_id")


def q_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status rows of one tenant and status, an equality filter on a keyed table."""
    status = status_from_labels(table(spark, sf_dir, "labels"))
    return point_get(status, tenant_id="src1", overall_status="completed").select(
        "file_id", "tenant_id", "overall_status", "result_key")
