"""Streaming completion trigger (ST1, ST3, ST4, ST6, ST7).

State is split so no key holds a big value: page completions are de-duplicated on
(document, page) first (a streaming ``dropDuplicates``, whose state is spread by the hash of both
columns, so a document with millions of pages is spread too), then one small row per document
counts distinct pages and keeps the latest total and status. Each micro-batch emits the
updated documents (update mode) to ``foreachBatch``, which writes them under
``<out>/updates/batch_id=<id>`` with overwrite: a replayed batch rewrites its own folder, so
the sink is idempotent and the output is exactly-once together with the checkpoint.

The current status table is the last update per document; a document *fires* in the first
batch where it is ready, exactly once. Page text never enters state; assembly joins the fired
ids back to the pages table (as a batch job), the way the reference re-reads pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.lifecycle import ready
from quire.operators.log import latest_per_key
from quire.operators.manifest import current_pages, guard, manifest_parts
from quire.operators.spread import semi_spread
from quire.session import checkpoint_root, start_with_partitions


COMPACT_EVERY = 16      # batches


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/quire/{name}/{uuid.uuid4().hex}"


def progress_state(progress: DataFrame, retention: str | None = None) -> DataFrame:
    """Stateful per-document progress over a stream of progress rows
    (file_id, ts, seq, page, total, status): distinct finished pages (first completion of each
    page only), latest total, latest status.

    With ``retention`` (e.g. ``"90 days"``, the records' time to live) the de-duplication state
    is bounded: an event-time watermark of that length lets Spark drop (document, page) keys
    older than it (``dropDuplicatesWithinWatermark``). Spark then also drops completions that
    arrive later than the retention, first ones included: choose it only where the records
    themselves have expired by then. Without it (the default) nothing is dropped, and the state
    holds a key per finished page."""
    pos = F.struct("ts", "seq")
    pages = progress.filter(F.col("page").isNotNull())
    if retention:
        firsts = (pages.withWatermark("ts", retention)
                  .dropDuplicatesWithinWatermark(["file_id", "page"]))
    else:
        firsts = pages.dropDuplicates(["file_id", "page"])
    rest = progress.filter(F.col("page").isNull())
    return firsts.unionByName(rest).groupBy("file_id").agg(
        F.count("page").cast("long").alias("processed_pages"),
        F.max_by("total", F.when(F.col("total").isNotNull(), pos)).cast("long")
        .alias("total_pages"),
        F.max_by("status", F.when(F.col("status").isNotNull(), pos)).alias("overall_status"),
        F.max("ts").alias("last_ts"))


def _read(spark: SparkSession, folder: str) -> DataFrame | None:
    """What is under ``folder``; None when nothing was written there."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if any(m in str(e) for m in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA",
                                     "Path does not exist")):
            return None
        raise


def _waiting(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Documents deferred by the batch before this one. A batch writes all that still wait, so
    no older batch has to be read."""
    last = _read(spark, f"{out}/deferred/batch_id={batch_id - 1}")
    if last is None and batch_id > 0:       # a batch number was left out
        older = _read(spark, f"{out}/deferred")
        if older is not None:
            number = older.filter(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
            last = None if number is None else older.filter(F.col("batch_id") == number)
    return last


def _finished(spark: SparkSession, out: str, batch_id: int) -> DataFrame | None:
    """Ids of the documents finished before this batch: the last compacted list and the results
    of the batches since (partition-pruned)."""
    number = batch_id // COMPACT_EVERY * COMPACT_EVERY - 1
    compacted = _read(spark, f"{out}/finished/batch_id={number}") if number >= 0 else None
    since = _read(spark, f"{out}/results")
    if since is not None:
        since = since.filter((F.col("batch_id") < batch_id) & (
            F.col("batch_id") > (number if compacted is not None else -1))).select("file_id")
    parts = [x.select("file_id") for x in (compacted, since) if x is not None]
    return parts[0].union(parts[-1]).distinct() if parts else None


def assemble_batch(spark: SparkSession, out: str, batch_id: int, pages: DataFrame,
                   processed_at, dedupe_pages: bool = True) -> None:
    """Assemble the documents that are ready in this batch (ST3, ST4, ST6).

    Candidates are the documents that turned up ready in this batch plus those deferred by the
    batch before; documents finished by an earlier batch are skipped. The guard compares page
    rows with the total: complete documents get their manifest header written under
    ``results/batch_id=<id>`` and their chunks under ``result_chunks/batch_id=<id>`` (flat,
    one row per page), the rest under ``deferred/batch_id=<id>`` (retried next batch). Every
    ``COMPACT_EVERY`` batches the finished ids are written as one list, so a batch reads its own
    updates, what waits, that list and few small results, not the history.
    Everything is written with overwrite, so replaying the batch rewrites the same output.
    """
    mine = spark.read.parquet(f"{out}/updates/batch_id={batch_id}")
    cands = mine.filter("ready").select("file_id", "total_pages")
    waiting = _waiting(spark, out, batch_id)
    if waiting is not None:
        # one with an update in this batch is a candidate only if it still is ready
        cands = cands.unionByName(waiting.select("file_id", "total_pages").join(
            mine.select("file_id"), "file_id", "left_anti"))
    done = _finished(spark, out, batch_id)
    if done is not None:
        cands = cands.join(done, "file_id", "left_anti")
    cands = cands.dropDuplicates(["file_id"])
    cols = [c for c in ("file_id", "tenant_id", "page_number", "page_analysis", "updated_at")
            if c in pages.columns]
    pages = semi_spread(pages.select(*cols), cands, ["file_id"], "page_number")
    if dedupe_pages and "updated_at" in pages.columns:
        pages = current_pages(pages)
    decided = guard(cands, pages)
    go = decided.filter(F.col("action") == "assemble").select("file_id", "total_pages")
    headers, chunks = manifest_parts(pages, go, processed_at, how="inner")
    chunks = semi_spread(chunks, go, ["file_id"], "page_number")
    (headers.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").parquet(f"{out}/results/batch_id={batch_id}"))
    (chunks.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .sortWithinPartitions("file_id", "page_number")
     .write.mode("overwrite").parquet(f"{out}/result_chunks/batch_id={batch_id}"))
    (decided.filter(F.col("action") == "deferred").select("file_id", "total_pages", "pages_found")
     .withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").parquet(f"{out}/deferred/batch_id={batch_id}"))
    if (batch_id + 1) % COMPACT_EVERY == 0:
        ended = _read(spark, f"{out}/results/batch_id={batch_id}")
        ids = [x.select("file_id") for x in (done, ended) if x is not None]
        if ids:
            (ids[0].union(ids[-1]).distinct().sortWithinPartitions("file_id")
             .write.mode("overwrite").parquet(f"{out}/finished/batch_id={batch_id}"))


def _writer(out: str, pages: DataFrame | None, processed_at):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("ready", ready("processed_pages", "total_pages", "overall_status"))
         .withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(f"{out}/updates/batch_id={batch_id}"))
        if pages is not None:
            at = F.current_timestamp() if processed_at is None else processed_at
            assemble_batch(batch.sparkSession, out, batch_id, pages, at)
    return write


def start_completion(progress: DataFrame, out: str, checkpoint: str,
                     available_now: bool = True, interval: str = "5 seconds",
                     pages: DataFrame | None = None,
                     processed_at=None,
                     retention: str | None = None,
                     state_partitions: int | None = None) -> StreamingQuery:
    """Start the completion query. ``available_now`` drains what is there and stops (replays,
    tests); otherwise a processing-time trigger of ``interval``. With a ``pages`` table
    (file_id, tenant_id, page_number, page_analysis), each batch also assembles the manifests
    of documents that became ready (``assemble_batch``), stamped with ``processed_at`` or, when
    that is None, with the time of the batch."""
    w = (progress_state(progress, retention).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(_writer(out, pages, processed_at)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return start_with_partitions(w, progress.sparkSession, state_partitions)


def current_status(spark: SparkSession, out: str) -> DataFrame:
    """Status table: the last update of every document (max batch id)."""
    ups = spark.read.parquet(f"{out}/updates")
    return latest_per_key(ups, ["file_id"], ["batch_id"])


def fired(spark: SparkSession, out: str) -> DataFrame:
    """Documents that fired: the first batch in which each became ready (once per document)."""
    ups = spark.read.parquet(f"{out}/updates").filter("ready")
    return ups.groupBy("file_id").agg(F.min("batch_id").alias("fired_batch"))


def records_behind(query: StreamingQuery) -> dict[str, float | None]:
    """Lag per source from the last progress report (ST7): offsets behind the newest record
    where the source reports it (Kafka), else None."""
    p = query.lastProgress or {}
    out = {}
    for src in p.get("sources", []):
        m = src.get("metrics") or {}
        lag = m.get("maxOffsetsBehindLatest") or m.get("avgOffsetsBehindLatest")
        out[src.get("description", "source")] = float(lag) if lag is not None else None
    return out


def millis_behind(spark: SparkSession, out: str, now=None) -> int | None:
    """Milliseconds from the newest record taken in to ``now`` (default: the present), as the
    updates tell (ST7); None before the first record."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    newest = F.max(F.col("last_ts").cast("timestamp"))
    ups = spark.read.parquet(f"{out}/updates")
    return ups.agg(F.unix_millis(at) - F.unix_millis(newest)).first()[0]
