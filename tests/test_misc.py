"""Small operators: deterministic ids, point get, document errors, semi/anti views, items."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators.catalog import catalog_files, file_id_for, validate_uploads
from quire.operators.log import point_get
from quire.operators.pages import document_errors, join_items, prompt, with_page_keys
from quire.operators.views import (
    available_files, documents_by_tenant, results_available, tenant_recent, unavailable_files,
)

T0 = dt.datetime(2024, 1, 1)


def test_file_id_is_deterministic(spark):
    df = spark.createDataFrame([("t", "a.pdf", T0)], "tenant_id string, file_name string, "
                                                     "uploaded_at timestamp")
    a = df.select(file_id_for("tenant_id", "file_name", "uploaded_at").alias("i")).first().i
    b = df.select(file_id_for("tenant_id", "file_name", "uploaded_at").alias("i")).first().i
    assert a == b and len(a) == 64


def test_point_get_and_page_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "file_id string, page_number int")
    assert point_get(df, file_id="b").collect()[0].page_number == 2
    assert point_get(df, file_id="zz").count() == 0
    keys = with_page_keys(df).orderBy("file_id").collect()
    assert (keys[0].pk, keys[0].sk) == ("DOC#a", "PAGE#0001")


def test_document_errors_and_items(spark):
    docs = spark.createDataFrame([("a", "t", None), ("b", "t", "x")],
                                 "file_id string, tenant_id string, text string")
    assert [(r.file_id, r.overall_status) for r in document_errors(docs).collect()] == [
        ("a", "failed")]
    items = spark.createDataFrame([(["Hello", None, "world"],)], "items array<string>")
    assert items.select(join_items("items").alias("t")).first().t == "Hello  world"
    p = spark.createDataFrame([("100% sure",)], "t string").select(prompt("t").alias("p")).first().p
    assert "Text:\n100% sure\n\nReturn ONLY the JSON object." in p


def test_catalog_and_validation(spark):
    ups = spark.createDataFrame(
        [("f1", "t", "a.pdf", 10485760, T0, "", True), ("f2", "", "b.pdf", 5, T0, "bk", True),
         ("f3", "t", "c.pdf", 5, T0, None, False)],
        "file_id string, tenant_id string, file_name string, file_size long, "
        "uploaded_at timestamp, bucket string, has_file boolean")
    v = {r.file_id: (r.valid, r.reject_reason) for r in validate_uploads(ups).collect()}
    assert v == {"f1": (True, None), "f2": (False, "Tenant ID is required"),
                 "f3": (False, "No file uploaded")}
    cat = {r.file_id: r for r in catalog_files(ups, "2024-01-01 00:00:00").collect()}
    assert cat["f1"].processing_type == "async" and cat["f2"].processing_type == "sync"
    assert cat["f1"].s3_bucket == "pdfs" and cat["f2"].s3_bucket == "bk"
    assert cat["f1"].pk == "FILE#f1" and cat["f1"].gsi1sk == "FILE#2024-01-01T00:00:00.000Z"
    assert cat["f1"].s3_key == "t/f1/a.pdf" and cat["f1"].status == "uploaded"


def test_views_semi_anti_and_listings(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_id string")
    status = spark.createDataFrame([("a", "k"), ("b", None)], "file_id string, result_key string")
    assert [r.file_id for r in available_files(files, status).collect()] == ["a"]
    assert sorted(r.file_id for r in unavailable_files(files, status).collect()) == ["b", "c"]
    flags = {r.file_id: r.available for r in results_available(files, status).collect()}
    assert flags == {"a": True, "b": False, "c": False}
    rows = [("t1", f"f{i}", "n", "uploaded", T0 + dt.timedelta(minutes=i % 7)) for i in range(30)]
    cat = spark.createDataFrame(rows, "tenant_id string, file_id string, file_name string, "
                                      "status string, uploaded_at timestamp")
    one = tenant_recent(cat, 5, tenant="t1").orderBy("rank").collect()
    many = tenant_recent(cat, 5).orderBy("rank").collect()
    assert [r.file_id for r in one] == [r.file_id for r in many]
    assert [r.file_id for r in one] == ["f13", "f20", "f27", "f6", "f12"]
    st = spark.createDataFrame(
        [("d1", "t", "processing", T0, T0 + dt.timedelta(hours=5)),
         ("d2", "t", "completed", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)),
         ("d3", None, "processing", T0, T0)],
        "file_id string, tenant_id string, overall_status string, created_at timestamp, "
        "updated_at timestamp")
    assert [r.file_id for r in documents_by_tenant(st).orderBy("rank").collect()] == ["d1", "d2"]
    assert [r.file_id for r in documents_by_tenant(st, compat=True).orderBy("rank")
            .collect()] == ["d2", "d1"]
    assert [r.file_id for r in documents_by_tenant(st, status_filter="completed")
            .collect()] == ["d2"]


def test_derived_status_and_failed_pages(spark):
    from quire.operators.views import derive_failed_pages, derive_file_status
    files = spark.createDataFrame([("a", "uploaded"), ("b", "uploaded"), ("c", "uploaded")],
                                  "file_id string, status string")
    st = spark.createDataFrame([("a", "aggregating", 0), ("b", "completed", 0)],
                               "file_id string, overall_status string, failed_pages int")
    got = {r.file_id: r.status for r in derive_file_status(files, st).collect()}
    assert got == {"a": "processing", "b": "completed", "c": "uploaded"}
    assert {r.status for r in derive_file_status(files, st, compat=True).collect()} == {
        "uploaded"}
    pages = spark.createDataFrame([("a", '{"error":"x"}'), ("a", '{"s":1}'), ("b", None)],
                                  "file_id string, page_analysis string")
    fp = {r.file_id: r.failed_pages for r in derive_failed_pages(st, pages).collect()}
    assert fp == {"a": 1, "b": 0}
    assert {r.failed_pages for r in derive_failed_pages(st, pages, compat=True).collect()} == {0}


def test_view_json_shapes(spark):
    import json
    from quire.operators.views import job_json, job_view, tenant_listing_json, tenant_recent
    status = spark.createDataFrame(
        [("a", "t", "completed", 2, 2, 0, T0, T0, "t/a/results.json"),
         ("b", "t", "processing", 1, 3, 0, T0, None, None)],
        "file_id string, tenant_id string, overall_status string, processed_pages int, "
        "total_pages int, failed_pages int, started_at timestamp, completed_at timestamp, "
        "result_key string")
    files = spark.createDataFrame([("a", "a.pdf", T0)],
                                  "file_id string, file_name string, uploaded_at timestamp")
    docs = {r.file_id: json.loads(r.json) for r in job_json(job_view(status, files)).collect()}
    assert docs["a"]["result"] == {"s3Key": "t/a/results.json"}
    assert docs["a"]["progress"] == {"processed": 2, "total": 2, "failed": 0}
    assert docs["b"]["result"] is None and docs["b"]["fileName"] is None
    assert list(docs["a"]) == ["fileId", "fileName", "status", "progress", "timestamps",
                               "result"]
    cat = files.withColumn("tenant_id", F.lit("t")).withColumn("status", F.lit("uploaded"))
    one = json.loads(tenant_listing_json(tenant_recent(cat, 5)).first().json)
    assert one == {"fileId": "a", "fileName": "a.pdf", "status": "uploaded",
                   "uploadedAt": "2024-01-01T00:00:00.000Z"}


def test_checkpoint_root_needs_a_shared_folder_on_a_cluster(spark):
    import pytest
    from quire.session import checkpoint_root

    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

        def set(self, k, v):
            self[k] = v

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master, conf):
            self.conf, self.sparkContext = Conf(conf), Context(master)

    # on a cluster an unset folder is an error, never a machine-local fallback
    with pytest.raises(RuntimeError):
        checkpoint_root(Session("yarn", {}))
    # a folder the cluster names is used as is, and registered for RDD checkpoints
    s = Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/ckpt/"})
    assert checkpoint_root(s) == "hdfs://nn/shared/ckpt"
    assert s.sparkContext.dir == "hdfs://nn/shared/ckpt/"
    # the session under test keeps the folder it was given
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
