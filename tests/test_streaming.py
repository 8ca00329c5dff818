"""Streaming forms agree with batch forms; restarts resume; output is idempotent."""

import os

from pyspark.sql import functions as F

from quire.operators.alarm import error_alarm
from quire.operators.log import document_progress
from quire.plans.inputs import progress_log
from quire.plans.registry import QUERIES
from quire.sources.events import DOCUMENTS, EVENTS, read_event_files
from quire.streaming.alarm import final_windows, start_alarm
from quire.streaming.completion import current_status, fired, run_folder, start_completion

from conftest import SF01


def _split_events(spark, folder, parts=3):
    """The events table as ``parts`` files, each a contiguous time slice (a replay in order)."""
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    ev = ev.withColumn("_part", F.ntile(parts).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for p in range(1, parts + 1):
        (ev.filter(F.col("_part") == p).drop("_part").coalesce(1).write
         .parquet(os.path.join(folder, f"part{p}")))
    return [os.path.join(folder, f"part{p}") for p in range(1, parts + 1)]


def test_stream_completion_equals_batch_and_restarts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"))
    out = run_folder(spark, "test_completion")
    ck = f"{out}/_checkpoint"

    def add(i):
        # move one part's files into the watched folder (a new arrival)
        for f in os.listdir(parts[i]):
            if f.endswith(".parquet"):
                os.link(os.path.join(parts[i], f), os.path.join(src, f"p{i}-{f}"))

    add(0)
    start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)),
                     out, ck).awaitTermination()
    add(1)
    add(2)
    # restart from the checkpoint: only the new files are read
    q = start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)),
                         out, ck)
    q.awaitTermination()
    streamed = current_status(spark, out).filter("ready").select("file_id")
    batch = document_progress(progress_log(spark.read.parquet(f"{SF01}/events.parquet")))
    want = batch.filter("ready").select("file_id")
    assert streamed.count() == want.count() == 59
    assert streamed.exceptAll(want).count() == 0
    batches = spark.read.parquet(f"{out}/updates").select("batch_id").distinct().count()
    assert batches == 3
    # each document fires once; the fired set contains every document ready at the end
    f = fired(spark, out)
    assert f.count() == f.select("file_id").distinct().count()
    assert want.join(f, "file_id", "left_anti").count() == 0


def test_stream_alarm_equals_batch(spark, tmpdir_path):
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"))
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i, p in enumerate(parts):
        for f in os.listdir(p):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(src, f"p{i}-{f}"))
    errors = read_event_files(spark, src, max_files_per_trigger=1).filter(
        F.col("event_type") == "error")
    out = run_folder(spark, "test_alarm")
    start_alarm(errors, out, f"{out}/_checkpoint", period="6 hours").awaitTermination()
    streamed = final_windows(spark, out).select(F.col("metric"))
    batch = error_alarm(spark.read.parquet(f"{SF01}/events.parquet")
                        .filter(F.col("event_type") == "error"), "ts", "6 hours", 10)
    assert streamed.count() == batch.count() == 120
    assert sorted(r.metric for r in streamed.collect()) == sorted(
        r.metric for r in batch.collect())
    assert EVENTS.fieldNames()[0] == "event_id"


def test_streams_over_interleaved_files_lose_nothing(spark, tmpdir_path):
    """The events dealt over three files, each covering the whole time span, one file per
    micro-batch: rows far older than those already seen still count."""
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    src = os.path.join(tmpdir_path, "in")
    for i in range(3):
        (ev.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src))
    errors = read_event_files(spark, src, glob="*.parquet", max_files_per_trigger=1).filter(
        F.col("event_type") == "error")
    out = run_folder(spark, "test_interleaved_alarm")
    start_alarm(errors, out, f"{out}/_checkpoint", period="6 hours").awaitTermination()
    streamed = final_windows(spark, out)
    batch = error_alarm(ev.filter(F.col("event_type") == "error"), "ts", "6 hours", 10)
    assert sorted(r.metric for r in streamed.collect()) == sorted(r.metric for r in batch.collect())
    out = run_folder(spark, "test_interleaved_completion")
    start_completion(progress_log(read_event_files(spark, src, glob="*.parquet",
                                                   max_files_per_trigger=1)),
                     out, f"{out}/_checkpoint").awaitTermination()
    got = current_status(spark, out).filter("ready").select("file_id")
    want = document_progress(progress_log(ev)).filter("ready").select("file_id")
    assert got.count() == want.count() == 59 and got.exceptAll(want).count() == 0


def test_stream_assembles_each_document_once(spark, tmpdir_path):
    """Ready documents get one manifest; documents missing page rows are deferred."""
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"))
    for i, p in enumerate(parts):
        for f in os.listdir(p):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(src, f"p{i}-{f}"))
    prog = progress_log(spark.read.parquet(f"{SF01}/events.parquet"))
    # the page store: one row per finished (document, page), except page 1 of documents whose
    # id is divisible by 3 (those must be deferred)
    pages = (prog.filter(F.col("page").isNotNull())
             .select("file_id", F.lit("t").alias("tenant_id"),
                     F.col("page").alias("page_number"))
             .dropDuplicates(["file_id", "page_number"])
             .filter(~((F.col("file_id") % 3 == 0) & (F.col("page_number") == 1)))
             .withColumn("page_analysis", F.lit('{"summary":"p"}')))
    out = run_folder(spark, "test_assemble")
    start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)), out,
                     f"{out}/_checkpoint", pages=pages,
                     processed_at="2024-02-01 00:00:00").awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    assert results.count() == results.select("file_id").distinct().count()
    fired_ids = fired(spark, out).select("file_id")
    deferred = spark.read.parquet(f"{out}/deferred").select("file_id").distinct()
    # every fired document is either assembled or deferred, never both
    assert fired_ids.join(results.select("file_id"), "file_id", "left_anti").exceptAll(
        deferred).count() == 0
    assert results.join(deferred, "file_id", "left_semi").count() == 0
    assert deferred.filter(F.col("file_id") % 3 != 0).count() == 0
    r = results.first()
    assert r.success_count == r.total_pages and r.result_key.endswith("/results.json")


def test_stream_intake_quarantines_bad_records(spark, tmpdir_path):
    import json as _json
    from quire.sources.events import WIRE_WITH_SEQ
    from quire.streaming.intake import intake_table, start_intake
    good = {"eventType": "document.uploaded", "timestamp": "2024-01-01T00:00:00.000Z",
            "data": {"fileId": "f1", "tenantId": "t", "s3Key": "t/f1/a.pdf", "bucket": ""}}
    other = {"eventType": "chunk.ready", "data": {"fileId": "f2", "tenantId": "t"}}
    recs = [(1, "t", _json.dumps(good)), (2, "t", '{"eventType": "document.uploaded", '),
            (3, "t", _json.dumps(dict(good, data=dict(good["data"], fileId="f3")))),
            (4, "t#f2", _json.dumps(other))]
    src = os.path.join(tmpdir_path, "wire")
    spark.createDataFrame(recs, WIRE_WITH_SEQ).coalesce(1).write.json(src)
    out = run_folder(spark, "test_intake")
    start_intake(read_event_files(spark, src, schema=WIRE_WITH_SEQ, fmt="json"), out,
                 f"{out}/_checkpoint").awaitTermination()
    got = {r.seq: r for r in intake_table(spark, out).collect()}
    assert [got[i].disposition for i in (1, 2, 3, 4)] == ["process", "quarantine", "process",
                                                          "ignore"]
    assert got[1].bucket == "pdfs" and got[3].file_id == "f3"


def test_records_behind_reports_each_source(spark, tmpdir_path):
    import datetime as dt

    from quire.streaming.completion import millis_behind, records_behind
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=1)
    out = run_folder(spark, "test_lag")
    q = start_completion(progress_log(read_event_files(spark, parts[0])), out,
                         f"{out}/_checkpoint")
    q.awaitTermination()
    lag = records_behind(q)
    assert list(lag.values()) == [None]     # a folder of files reports no offsets
    newest = spark.read.parquet(f"{SF01}/events.parquet").agg(F.max("ts")).first()[0]
    later = newest + dt.timedelta(seconds=90)
    assert millis_behind(spark, out, later.isoformat(sep=" ")) == 90_000


def test_stream_replayed_file_changes_nothing(spark, tmpdir_path):
    """The same events arrive twice (two copies of one file): the streamed ready set still
    equals the batch result over the unique events."""
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=1)
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for copy in ("a", "b"):
        for f in os.listdir(parts[0]):
            if f.endswith(".parquet"):
                os.link(os.path.join(parts[0], f), os.path.join(src, f"{copy}-{f}"))
    out = run_folder(spark, "test_replay")
    start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)), out,
                     f"{out}/_checkpoint").awaitTermination()
    streamed = current_status(spark, out).filter("ready").select("file_id")
    batch = document_progress(progress_log(spark.read.parquet(f"{SF01}/events.parquet")))
    want = batch.filter("ready").select("file_id")
    assert streamed.count() == want.count() == 59
    assert streamed.exceptAll(want).count() == 0


def test_stream_completion_with_bounded_dedupe_state(spark, tmpdir_path):
    """A retention-bounded dedupe gives the same result while replays stay within it."""
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=2)
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i, p in enumerate(parts + parts[:1]):  # the first slice arrives twice
        for f in os.listdir(p):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(src, f"p{i}-{f}"))
    out = run_folder(spark, "test_retention")
    start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)), out,
                     f"{out}/_checkpoint", retention="90 days").awaitTermination()
    streamed = current_status(spark, out).filter("ready").select("file_id")
    batch = document_progress(progress_log(spark.read.parquet(f"{SF01}/events.parquet")))
    want = batch.filter("ready").select("file_id")
    assert streamed.count() == want.count() == 59
    assert streamed.exceptAll(want).count() == 0


def test_stream_completion_on_rocksdb_state_store(spark, tmpdir_path):
    """The production state store (RocksDB) gives the same result; set before a fresh start."""
    key = "spark.sql.streaming.stateStore.providerClass"
    prev = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state."
                        "RocksDBStateStoreProvider")
    try:
        parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=2)
        src = os.path.join(tmpdir_path, "in")
        os.makedirs(src)
        for i, p in enumerate(parts):
            for f in os.listdir(p):
                if f.endswith(".parquet"):
                    os.link(os.path.join(p, f), os.path.join(src, f"p{i}-{f}"))
        out = run_folder(spark, "test_rocksdb")
        start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)),
                         out, f"{out}/_checkpoint").awaitTermination()
        streamed = current_status(spark, out).filter("ready").select("file_id")
        assert streamed.count() == 59
    finally:
        spark.conf.set(key, prev)


def test_state_partitions_are_fixed_at_first_start(spark, tmpdir_path):
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=1)
    out = run_folder(spark, "test_state_parts")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    start_completion(progress_log(read_event_files(spark, parts[0])), out, f"{out}/_checkpoint",
                     state_partitions=3).awaitTermination()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before  # session left as it was
    state = os.path.join(f"{out}/_checkpoint".replace("file:", ""), "state")
    ops = sorted(os.listdir(state))
    assert ops and all(
        sorted(d for d in os.listdir(os.path.join(state, op)) if d.isdigit()) == ["0", "1", "2"]
        for op in ops)
    assert current_status(spark, out).filter("ready").count() == 59


def test_replaying_a_batch_assembly_is_idempotent(spark, tmpdir_path):
    """Spark may run a micro-batch's sink again after a failure: assembling the same batch id
    twice rewrites the same results and never duplicates a document."""
    from quire.streaming.completion import assemble_batch
    parts = _split_events(spark, os.path.join(tmpdir_path, "staged"), parts=2)
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for i, p in enumerate(parts):
        for f in os.listdir(p):
            if f.endswith(".parquet"):
                os.link(os.path.join(p, f), os.path.join(src, f"p{i}-{f}"))
    prog = progress_log(spark.read.parquet(f"{SF01}/events.parquet"))
    pages = (prog.filter(F.col("page").isNotNull())
             .select("file_id", F.lit("t").alias("tenant_id"), F.col("page").alias("page_number"))
             .dropDuplicates(["file_id", "page_number"])
             .withColumn("page_analysis", F.lit('{"summary":"p"}')))
    out = run_folder(spark, "test_idempotent")
    start_completion(progress_log(read_event_files(spark, src, max_files_per_trigger=1)), out,
                     f"{out}/_checkpoint", pages=pages,
                     processed_at="2024-02-01 00:00:00").awaitTermination()
    before = sorted(tuple(r) for r in spark.read.parquet(f"{out}/results")
                    .select("file_id", "batch_id", "success_count").collect())
    last = max(b for _, b, _ in before)
    assemble_batch(spark, out, last, pages, "2024-02-01 00:00:00")  # the replay
    after = sorted(tuple(r) for r in spark.read.parquet(f"{out}/results")
                   .select("file_id", "batch_id", "success_count").collect())
    assert before == after and len({f for f, _, _ in after}) == len(after)


def test_batches_assemble_from_compacted_lists(spark, monkeypatch):
    """Six batches, compacted every second one: every document is assembled once although it
    turns up again, a deferred one when its page arrives, one no longer ready is dropped; the
    updates of older batches are not needed."""
    from quire.streaming import completion as C
    monkeypatch.setattr(C, "COMPACT_EVERY", 2)
    out = run_folder(spark, "test_compact")
    store = spark.createDataFrame([(f"d{i}", "t", 1, '{"s":1}') for i in range(6)],
                                  "file_id string, tenant_id string, page_number int, "
                                  "page_analysis string")
    late = spark.createDataFrame([("late", "t", 1, '{"s":1}')], store.schema)

    def batch(b, rows):
        (spark.createDataFrame([(f, 1, r, b) for f, r in rows],
                               "file_id string, total_pages long, ready boolean, batch_id long")
         .write.mode("overwrite").parquet(f"{out}/updates/batch_id={b}"))
        pages = store.unionByName(late) if b >= 3 else store
        C.assemble_batch(spark, out, b, pages, "2024-02-01 00:00:00")

    batch(0, [("d0", True), ("late", True), ("gone", True)])
    batch(1, [("d1", True), ("d0", True), ("gone", False)])
    for b in range(2, 6):
        batch(b, [(f"d{b}", True), (f"d{b - 2}", True)])
    batch(5, [("d5", True), ("d3", True)])      # a replay
    got = sorted((r.file_id, r.batch_id) for r in spark.read.parquet(f"{out}/results").collect())
    assert got == [("d0", 0), ("d1", 1), ("d2", 2), ("d3", 3), ("d4", 4), ("d5", 5), ("late", 3)]
    ids = [r.file_id for r in spark.read.parquet(f"{out}/finished/batch_id=5").collect()]
    assert sorted(ids) == ["d0", "d1", "d2", "d3", "d4", "d5", "late"]
    assert {r.file_id for r in spark.read.parquet(f"{out}/deferred/batch_id=1").collect()} == {
        "late"}


def test_a_table_is_streamed_as_one_file_or_as_a_folder_of_parts(spark, tmpdir_path):
    """A larger table is a folder of part files: the queries that stream a table read it whole."""
    docs = spark.createDataFrame(
        [(i, "\n".join(["p"] * (i % 3 + 1)), "en", f"s{i % 2}", 1) for i in range(40)],
        DOCUMENTS)
    docs.repartition(4).write.parquet(f"{tmpdir_path}/parts/documents.parquet")
    os.makedirs(f"{tmpdir_path}/one")
    docs.coalesce(1).write.parquet(f"{tmpdir_path}/staged")
    (part,) = [f for f in os.listdir(f"{tmpdir_path}/staged") if f.endswith(".parquet")]
    os.link(f"{tmpdir_path}/staged/{part}", f"{tmpdir_path}/one/documents.parquet")
    want = sorted(map(str, QUERIES["chunk_fanout"](spark, f"{tmpdir_path}/one").collect()))
    for kind in ("one", "parts"):
        got = QUERIES["stream_chunk_fanout"](spark, f"{tmpdir_path}/{kind}").collect()
        assert len(got) == 40 and sorted(map(str, got)) == want, kind
    ev = spark.read.parquet(f"{SF01}/events.parquet").where("event_id < 2000")
    ev.repartition(3).write.parquet(f"{tmpdir_path}/parts/events.parquet")
    for stream, batch in (("stream_completion", "ready_documents"),
                          ("stream_error_alarm", "error_alarm"),
                          ("stream_alarm_transitions", "alarm_transitions")):
        got, want = (sorted(map(str, QUERIES[q](spark, f"{tmpdir_path}/parts").collect()))
                     for q in (stream, batch))
        assert got == want and got, stream
