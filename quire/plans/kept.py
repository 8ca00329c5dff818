"""Queries over stored state and repeated runs: incremental folds, maintained listings, keyed
lookups, committed results, resumed annotation, publish retries, alarm edges, applied retention,
very large documents and the live change feed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.jsonrules import chunk_status
from quire.functions.lifecycle import iso_utc, ready
from quire.operators.alarm import windowed_counts
from quire.operators.annotate import annotate_native
from quire.operators.foldstate import apply_delta, folded, read_state
from quire.operators.ledger import annotate_resumable
from quire.operators.manifest import manifest_parts
from quire.operators.recent import apply_changes, build_recent
from quire.operators.retries import publish_with_retries
from quire.operators.transitions import alarm_transitions
from quire.plans.inputs import (
    NOW, annotation_fault, drilled_annotator, event_tenant, events_as_log, files_from_documents,
    now_col, pages_from_conversations, progress_log, status_change_log, status_from_labels, table,
)
from quire.plans.queries import _flat_analysis, _state_partitions
from quire.session import ensure_session_conf
from quire.sources.commits import write_attempt
from quire.sources.events import read_event_files, read_table_files
from quire.sources.expiring import apply_retention, read_expiring, write_expiring
from quire.sources.keyed import get_keys, write_keyed
from quire.sources.large import read_large_pages
from quire.sources.objects import read_results, write_results
from quire.streaming.alarm import final_windows, start_alarm
from quire.streaming.changes import start_change_feed
from quire.streaming.completion import run_folder

FIELDS = ("tenant_id", "overall_status", "total_pages", "error_message")
MICRO_BATCHES = 8


def q_status_fold_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status table from a stored state. Two thirds of the log make the snapshot, the
    rest arrives later as a delta, much of it older than rows already folded; same result as
    ``status_fold``."""
    log = status_change_log(table(spark, sf_dir, "events"))
    root = run_folder(spark, "status_fold_incremental")
    late = F.col("seq") % 3 == 0
    for run, part in (("snapshot", log.where(~late)), ("delta", log.where(late))):
        apply_delta(spark, root, run, part, FIELDS, "processed_pages")
    st = folded(read_state(spark, root, FIELDS, "processed_pages"))
    return st.select(
        "file_id", "tenant_id", "overall_status",
        F.col("total_pages").cast("long").alias("total_pages"),
        F.col("processed_pages").cast("long").alias("processed_pages"), "error_message",
        iso_utc("created_at").alias("created_at"), iso_utc("updated_at").alias("updated_at"),
        F.col("ops").cast("long").alias("ops"),
        ready(F.col("processed_pages"), F.col("total_pages").cast("long"),
              F.col("overall_status")).alias("ready"))


def q_tenant_recent_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest files of every tenant from a maintained index. It is built over three
    quarters of the files; the other quarter is added and every fifth file deleted, and only tenants
    that lose too many are read again."""
    files = (files_from_documents(table(spark, sf_dir, "documents"), extra=("doc_id",))
             .select("doc_id", "file_id", "tenant_id", "file_name", "uploaded_at"))
    added, deleted = F.col("doc_id") % 4 == 0, F.col("doc_id") % 5 == 1
    index = build_recent(files.where(~added))
    now = apply_changes(index, files.where(added), files.where(deleted), files.where(~deleted))
    return now.listing().select(
        "tenant_id", F.col("rank").cast("long").alias("rank"), "file_id", "file_name",
        iso_utc("uploaded_at").alias("uploaded_at"))


def q_point_get_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of documents looked up by id in a table clustered by id, with bloom filters; some
    of the ids asked for do not exist."""
    status = status_from_labels(table(spark, sf_dir, "labels"))
    path = f"{run_folder(spark, 'point_get_keys')}/status"
    write_keyed(status, path, "file_id", distinct=100_000)
    asked = (table(spark, sf_dir, "documents").where("doc_id % 97 = 0")
             .select(F.col("doc_id").cast("string").alias("file_id")))
    return get_keys(spark, path, asked, "file_id").select(
        "file_id", "tenant_id", "overall_status", "result_key")


def q_result_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 S6 ST6: results of runs 9 and 10, and of a run that was killed after its first output. The
    second run annotates what failed in the first again; its results count although "10" sorts
    before "9", and nothing of the killed run is seen."""
    root = run_folder(spark, "result_commits")
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    totals = pages.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("total_pages"))
    first = annotate_native(pages, now_col(), "page_text", fail=annotation_fault("conv_id", "turn"))
    write_results(*manifest_parts(first, totals, now_col()), root, run_id="9")
    failed = read_results(spark, root)[0].filter("failed_count > 0").select("file_id")
    again = annotate_native(pages.join(failed, "file_id", "left_semi"), now_col(), "page_text")
    write_results(*manifest_parts(again, totals, now_col(), how="inner"), root, run_id="10")
    _headers, chunks = manifest_parts(first, totals, now_col())
    write_attempt(chunks, root, "chunks", "killed", partition_by=["tenant_id"])
    headers, stored = read_results(spark, root)
    found = stored.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))
    return headers.join(found, "file_id").select(
        "file_id", "tenant_id", "run_id", F.col("total_pages").cast("long").alias("total_pages"),
        "success_count", "failed_count", "chunks", "result_key")


def q_annotate_resumable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 M5: annotation that stops after four of eight waves and is started again; pages answered
    before are not asked for again (same result as ``annotate_callable``)."""
    pages = pages_from_conversations(table(spark, sf_dir, "conversations"))
    root = run_folder(spark, "annotate_resumable")
    options = {"delay": 0.0, "tasks": _state_partitions(spark)}
    annotate_resumable(pages, drilled_annotator, now_col(), root, most_waves=4, **options)
    done = annotate_resumable(pages, drilled_annotator, now_col(), root, **options)
    return _flat_analysis(done).select(
        "file_id", "page_number", F.col("attempts").cast("long").alias("attempts"),
        chunk_status("outcome").alias("chunk_status"), "summary", "error")


def refusing_transport(batches: DataFrame, attempt: int) -> DataFrame:
    """A stand-in batch call: refuses the records at every fourth place, another one each time."""
    return batches.withColumn("error_code", F.when(
        (F.col("batch_index") + 3 * attempt) % 4 == 0,
        F.lit("ProvisionedThroughputExceededException")))


def q_publish_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's events published in batches of 500; what is refused is numbered into
    new batches and sent again, four attempts in all; the rest are dead letters."""
    log = (events_as_log(table(spark, sf_dir, "events"))
           .select(event_tenant("user_id").alias("tenant_id"), "ts", "seq"))
    sent, dead, _totals = publish_with_retries(log, refusing_transport, ["tenant_id"], ["ts", "seq"])
    out = sent.withColumn("status", F.lit("sent")).unionByName(
        dead.drop("error_code").withColumn("status", F.lit("dead")))
    return out.select("seq", "tenant_id", F.col("attempts").cast("long").alias("attempts"), "status")


def _edges(counts: DataFrame) -> DataFrame:
    return alarm_transitions(counts, "1 HOUR", 2).select(
        iso_utc("window_start").alias("window_start"), "metric", "from_state", "to_state", "lasted")


def q_alarm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: when the hourly error alarm (more than 2) goes on and off, hours without errors
    included."""
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    counts = windowed_counts(errors, "ts", "1 hour")
    return _edges(counts.select(F.col("w.start").alias("window_start"), "metric"))


def q_stream_alarm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8 A5: the same from windows counted by the stream."""
    errors = read_table_files(spark, sf_dir, "events").filter(
        F.col("event_type") == "error")
    out = run_folder(spark, "stream_alarm_transitions")
    start_alarm(errors, out, f"{out}/_checkpoint", period="1 hour",
                state_partitions=_state_partitions(spark)).awaitTermination()
    return _edges(final_windows(spark, out).select(
        F.col("window_start_ts").alias("window_start"), "metric"))


def q_retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files older than 90 days are moved to the archive and their days deleted; what is
    kept and what is archived."""
    root = run_folder(spark, "retention_applied")
    files = (files_from_documents(table(spark, sf_dir, "documents"))
             .select("file_id", "tenant_id", "uploaded_at"))
    write_expiring(files, f"{root}/files", F.col("uploaded_at") + F.expr("INTERVAL 90 DAYS"))
    apply_retention(spark, f"{root}/files", NOW, archive=f"{root}/archive")
    out = None
    for state in ("files", "archive"):
        part = read_expiring(spark, f"{root}/{state}")
        if part is not None:
            part = part.select("file_id", "tenant_id", F.lit(
                "kept" if state == "files" else "archived").alias("state"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else files.limit(0).select(
        "file_id", "tenant_id", F.lit("").alias("state"))


def q_split_pages_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a source as one large text file, split into pages by byte ranges and
    numbered by prefix counts."""
    ensure_session_conf(spark)
    root = run_folder(spark, "split_pages_large")
    name = F.md5(F.coalesce("source", F.lit(""))).alias("file")
    (table(spark, sf_dir, "documents").where("text IS NOT NULL").select(name, "doc_id", "text")
     .repartition("file").sortWithinPartitions("file", "doc_id").select("file", "text")
     .write.partitionBy("file").text(root))
    pages = read_large_pages(spark, root, range_bytes=1 << 20)
    return pages.select(
        F.regexp_extract("path", "file=([0-9a-f]+)/", 1).alias("file_id"), "page_number",
        "total_pages", F.length("page_text").cast("long").alias("page_chars"),
        F.md5("page_text").alias("page_md5"))


def _arriving(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The events as files that overlap in time: five days each, and every third event one file
    late. A last file holds a row far ahead, as the next day's traffic would be."""
    events = table(spark, sf_dir, "events")
    slot = F.floor(F.datediff("ts", F.lit("2000-01-01")) / 5) + F.when(
        F.col("event_id") % 3 == 0, 1).otherwise(0)
    rows = events.withColumn("slot", slot)
    for (s,) in sorted(r for r in rows.select("slot").distinct().collect()):
        rows.where(F.col("slot") == s).drop("slot").write.mode("append").parquet(folder)
    ahead = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 20 DAYS"))
        .cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))
    ahead.write.mode("append").parquet(folder)


def q_stream_change_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 W3 P7: the change feed from a stream of overlapping files in several micro-batches, put in
    order by event time inside the stream (same result as ``change_images``)."""
    out = run_folder(spark, "stream_change_images")
    _arriving(spark, sf_dir, f"{out}/incoming")
    files = len(spark.read.parquet(f"{out}/incoming").inputFiles())
    events = read_event_files(spark, f"{out}/incoming",
                              max_files_per_trigger=math.ceil(files / MICRO_BATCHES))
    start_change_feed(progress_log(events), f"{out}/images", f"{out}/_checkpoint", "12 days",
                      state_partitions=_state_partitions(spark)).awaitTermination()
    return spark.read.parquet(f"{out}/images").where("op = 'MODIFY'").select(
        "file_id", "seq", iso_utc("ts").alias("ts"), "old_processed", "old_total", "old_status",
        "new_processed", "new_total", "new_status",
        ready("new_processed", "new_total", "new_status").alias("level_trigger"))
