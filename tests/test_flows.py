"""The three entry flows end to end on a small fixture."""

import json

from pyspark.sql import functions as F

from quire.flows import (
    accept_uploads, complete_documents, job_results, job_status, process_documents, tenant_jobs,
)

NOW = "2024-02-01 00:00:00"


def test_upload_process_complete(spark):
    uploads = spark.createDataFrame(
        [("t1", "small.txt", 100, True), ("t1", "big.txt", 11 * 1024 * 1024, True),
         ("", "anon.txt", 5, True), ("t2", "none.txt", 0, False)],
        "tenant_id string, file_name string, file_size long, has_file boolean")
    up = accept_uploads(uploads, NOW)
    files = {r.file_name: r for r in up.files.collect()}
    assert set(files) == {"small.txt", "big.txt"}
    assert files["small.txt"].processing_type == "sync"
    assert files["big.txt"].processing_type == "async"
    assert {r.reject_reason for r in up.rejected.collect()} == {
        "Tenant ID is required", "No file uploaded"}
    ev = up.events.collect()
    data = json.loads(ev[0].value)["data"]
    assert len(ev) == 1 and data["fileName"] == "big.txt"
    assert data["fileSize"] == 11 * 1024 * 1024     # a number stays a number
    assert up.status_log.count() == 2

    texts = {"small.txt": "Alpha one. Beta two!\nGamma three?", "big.txt": "Delta.\n\nEpsilon."}
    docs = up.files.select("file_id", "tenant_id", "file_name").withColumn(
        "text", F.when(F.col("file_name") == "small.txt", F.lit(texts["small.txt"]))
        .otherwise(F.lit(texts["big.txt"])))
    pr = process_documents(docs, NOW, partitions=4)
    assert pr.pages.count() == 5 and pr.failed.count() == 0
    # drop one page of big.txt: it must be deferred, small.txt completed
    big_id = files["big.txt"].file_id
    kept = pr.pages.filter(~((F.col("file_id") == big_id) & (F.col("page_number") == 2)))
    done = complete_documents(pr.progress_log, kept, NOW)
    m = {r.file_id: r for r in done.manifests.collect()}
    small_id = files["small.txt"].file_id
    assert list(m) == [small_id] and m[small_id].success_count == 2
    upd = {r.file_id: r for r in done.status_updates.collect()}
    assert upd[small_id].overall_status == "completed"
    assert upd[small_id].result_key == f"t1/{small_id}/results.json"
    assert upd[big_id].overall_status == "processing"
    assert [r.file_id for r in done.deferred.collect()] == [big_id]
    assert [(r.file_id, r.overall_status) for r in done.aggregating.collect()] == [
        (small_id, "aggregating")]
    assert job_results(done.manifests, small_id).count() == 1
    newest = tenant_jobs(up.files, "t1", 1).collect()
    assert len(newest) == 1 and newest[0].file_id == min(small_id, big_id)  # same time: id order
    status = up.files.select("file_id", "tenant_id").withColumn(
        "overall_status", F.lit("processing")).withColumn("processed_pages", F.lit(1)) \
        .withColumn("total_pages", F.lit(2)).withColumn("failed_pages", F.lit(0)) \
        .withColumn("started_at", F.lit(NOW).cast("timestamp")) \
        .withColumn("completed_at", F.lit(None).cast("timestamp")) \
        .withColumn("result_key", F.lit(None).cast("string"))
    js = job_status(status, up.files, file_id=small_id).first()
    assert js.status == "processing" and js.percent == 50.0 and js.result is None


def test_replayed_pages_give_the_same_manifest(spark):
    docs = spark.createDataFrame([("f1", "t", "One. Two.\nThree!")],
                                 "file_id string, tenant_id string, text string")
    pr = process_documents(docs, NOW, partitions=2)
    once = complete_documents(pr.progress_log, pr.pages, NOW)
    # the same page writes arrive again (a replay), one of them later with the same content
    replay = pr.pages.unionByName(pr.pages.withColumn(
        "updated_at", F.col("updated_at") + F.expr("INTERVAL 1 MINUTE")))
    twice = complete_documents(pr.progress_log.unionByName(pr.progress_log), replay, NOW)
    a = once.manifests.drop("processed_at").collect()
    b = twice.manifests.drop("processed_at").collect()
    assert a == b and a[0].success_count == 2 and a[0].total_pages == 2
    assert twice.chunks.count() == 2


def test_upload_ids_distinguish_requests(spark):
    uploads = spark.createDataFrame(
        [("t", "a.pdf", 10, True, "r1"), ("t", "a.pdf", 10, True, "r2"),
         ("t", "a.pdf", 10, True, "r1")],
        "tenant_id string, file_name string, file_size long, has_file boolean, "
        "request_id string")
    ids = [r.file_id for r in accept_uploads(uploads, NOW).files.collect()]
    assert len(ids) == 3 and len(set(ids)) == 2  # r1 resent maps to the same id


_SEEN = set()


def _model_like(text):
    """Rate-limits the first request for each text, then answers with a fenced JSON reply."""
    if text not in _SEEN:
        _SEEN.add(text)
        raise RuntimeError("429 Too Many Requests")
    return "```json\n{\"summary\": \"%s\"}\n```" % text.strip()


def test_flow_with_a_callable_annotator(spark):
    docs = spark.createDataFrame([("f1", "t", "One.\nTwo."), ("f2", "t", "Three.")],
                                 "file_id string, tenant_id string, text string")
    pr = process_documents(docs, NOW, annotator=_model_like, partitions=2,
                           annotator_options={"delay": 0.0, "concurrency": 2,
                                              "prompted": False})
    got = {(r.file_id, r.page_number): json.loads(r.page_analysis)["summary"]
           for r in pr.pages.collect()}
    assert got == {("f1", 1): "One.", ("f1", 2): "Two.", ("f2", 1): "Three."}
    done = complete_documents(pr.progress_log, pr.pages, NOW)
    assert sorted((r.file_id, r.success_count) for r in done.manifests.collect()) == [
        ("f1", 2), ("f2", 1)]
