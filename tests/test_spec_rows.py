"""The rows the reference's own specs assert (FIXTURES.md section 2), on the Spark operators."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions.keys import (
    METADATA_SK, STATUS_SK, doc_pk, file_pk, page_sk,
)
from quire.operators.log import change_images, completion_edges, fold, modify_status_changes
from quire.operators.views import tenant_recent

T0 = dt.datetime(2024, 1, 1)
LOG = ("file_id string, ts timestamp, seq long, op string, fields map<string,string>, "
       "inc long")


def _log(spark, rows):
    return spark.createDataFrame([(f, T0 + dt.timedelta(seconds=i), i, op, m, inc)
                                  for i, (f, op, m, inc) in enumerate(rows)], LOG)


def test_file_put_update_delete_and_tenant_list(spark):
    put = {"file_name": "test-document.pdf", "file_size": "1024000", "tenant_id": "test-tenant",
           "user_id": "user-123", "processing_type": "async", "status": "uploaded"}
    log = _log(spark, [("test-file-1", "put", put, None)])
    rec = fold(log, list(put)).first()
    keys = log.select(file_pk("file_id").alias("pk"), F.lit(METADATA_SK).alias("sk")).first()
    assert (keys.pk, keys.sk, rec.status) == ("FILE#test-file-1", "METADATA", "uploaded")
    updated = _log(spark, [("test-file-1", "put", put, None),
                           ("test-file-1", "set", {"status": "processing"}, None)])
    assert fold(updated, list(put)).first().status == "processing"
    deleted = _log(spark, [("test-file-1", "put", put, None),
                           ("test-file-1", "set", {"status": "processing"}, None),
                           ("test-file-1", "delete", None, None)])
    assert fold(deleted, list(put)).count() == 0
    files = fold(log, list(put)).withColumn("uploaded_at", F.col("created_at"))
    listed = tenant_recent(files, 50, tenant="test-tenant").collect()
    assert len(listed) == 1 and listed[0].tenant_id == "test-tenant"


def test_status_put_partial_set_increment(spark):
    put = {"tenant_id": "test-tenant", "overall_status": "pending", "total_pages": "10",
           "processed_pages": "0", "failed_pages": "0"}
    log = _log(spark, [("doc-1", "put", put, None)])
    st = fold(log, ["overall_status", "total_pages"], counter="processed_pages").first()
    assert (st.overall_status, st.total_pages, st.processed_pages) == ("pending", "10", 0)
    keys = log.select(doc_pk("file_id").alias("pk"), F.lit(STATUS_SK).alias("sk")).first()
    assert (keys.pk, keys.sk) == ("DOC#doc-1", "STATUS")
    log = _log(spark, [("doc-1", "put", put, None),
                       ("doc-1", "set", {"overall_status": "processing",
                                         "processed_pages": "5"}, None),
                       ("doc-1", "inc", None, 1)])
    st = fold(log, ["overall_status"], counter="processed_pages").first()
    assert (st.overall_status, st.processed_pages) == ("processing", 6)


def test_page_puts_listed_by_prefix(spark):
    pages = spark.createDataFrame(
        [("doc-1", 1, '{"summary":"test"}', ["chunk-1", "chunk-2"]),
         ("doc-1", 2, '{"summary":"page 2"}', None)],
        "file_id string, page_number int, page_analysis string, chunk_ids array<string>")
    keyed = pages.select(doc_pk("file_id").alias("pk"), page_sk("page_number").alias("sk"),
                         "chunk_ids")
    rows = keyed.filter(F.col("pk") == "DOC#doc-1").filter(F.col("sk").startswith("PAGE#"))
    got = sorted((r.sk, r.chunk_ids) for r in rows.collect())
    assert got == [("PAGE#0001", ["chunk-1", "chunk-2"]), ("PAGE#0002", None)]


def test_change_images_4_to_5_and_9_to_10(spark):
    rows = [("d", None, 10, "processing")] + [("d", p, None, None) for p in range(1, 11)]
    df = spark.createDataFrame(
        [(f, T0 + dt.timedelta(seconds=i), i, p, t, s) for i, (f, p, t, s) in enumerate(rows)],
        "file_id string, ts timestamp, seq long, page int, total int, status string")
    mods = modify_status_changes(change_images(df, n_segments=3))
    img = {(r.old_processed, r.new_processed): r for r in mods.collect()}
    assert (4, 5) in img and (9, 10) in img
    edges = completion_edges(mods).collect()
    assert [(e.new_processed, e.new_total) for e in edges] == [(10, 10)]
