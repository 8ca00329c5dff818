"""Manifest assembly, guard, change-log fold, progress, change images."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.log import (
    change_images, completion_edges, document_progress, fold, latest_per_key,
    modify_status_changes, single_table,
)
from quire.operators.manifest import guard, manifest_chunks, manifest_header, manifest_nested
from quire.operators.pages import split_pages

T0 = dt.datetime(2024, 1, 1)


def test_manifest_counts_and_order(spark):
    rows = [("d1", "t", 10000, '{"summary":"x"}'), ("d1", "t", 9999, '{"error":"boom"}'),
            ("d1", "t", 2, None), ("d1", "t", 1, '[1]'),
            ("d2", "t", 1, '{"a":1}'), ("d2", "t", 2, "null")]
    pages = spark.createDataFrame(rows, "file_id string, tenant_id string, page_number int, "
                                        "page_analysis string")
    head = {r.file_id: r for r in manifest_header(pages).collect()}
    d1, d2 = head["d1"], head["d2"]
    assert (d1.success_count, d1.failed_count, d1.missing_count, d1.invalid_count) == (2, 1, 1, 0)
    assert d1.document_status == "completed"
    assert d2.invalid_count == 1 and d2.document_status == "failed"
    assert d2.error_message.startswith("Aggregation failed: ")
    chunks = manifest_chunks(pages).filter("file_id = 'd1'").orderBy("page_number").collect()
    assert [c.page_number for c in chunks] == [1, 2, 9999, 10000]
    assert [c.chunk_status for c in chunks] == ["success", "success", "failed", "success"]
    assert chunks[1].analysis is None  # missing analysis: labelled success, no analysis
    totals = spark.createDataFrame([("d1", 4), ("d2", 2)], "file_id string, total_pages int")
    nested = manifest_nested(pages, totals, "2024-02-01 00:00:00").collect()
    assert [n.file_id for n in nested] == ["d1"]  # d2 fails instead of getting a manifest
    n = nested[0]
    assert [c.page_number for c in n.chunks] == [1, 2, 9999, 10000]
    assert n.result_key == "t/d1/results.json" and n.total_pages == 4
    assert json.loads(n.chunks[3].analysis) == {"summary": "x"}


def test_guard(spark):
    ready = spark.createDataFrame([("a", 10), ("b", 10)], "file_id string, total_pages int")
    pages = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(11)],
                                  "file_id string, page_number int")
    got = {r.file_id: (r.pages_found, r.action) for r in guard(ready, pages).collect()}
    assert got == {"a": (9, "deferred"), "b": (11, "assemble")}


def test_split_pages_counts_empty_pages(spark):
    docs = spark.createDataFrame([("a", "t", "x\n\ny"), ("b", "t", ""), ("c", "t", None)],
                                 "file_id string, tenant_id string, text string")
    got = {(r.file_id, r.page_number): (r.page_text, r.total_pages)
           for r in split_pages(docs).collect()}
    assert got == {("a", 1): ("x", 3), ("a", 2): ("", 3), ("a", 3): ("y", 3), ("b", 1): ("", 1)}


LOG_SCHEMA = ("file_id string, ts timestamp, seq long, op string, fields map<string,string>, "
              "inc long")


def _log(spark, rows):
    return spark.createDataFrame(
        [(f, T0 + dt.timedelta(seconds=i), i, op, fields, inc)
         for i, (f, op, fields, inc) in enumerate(rows)], LOG_SCHEMA)


def test_fold_put_set_put(spark):
    log = _log(spark, [
        ("a", "put", {"status": "pending", "total": "10", "n": "0"}, None),
        ("a", "set", {"status": "processing", "n": "5"}, None),
        ("a", "inc", None, 1),
        ("b", "put", {"status": "pending", "total": "3", "n": "0"}, None),
        ("b", "set", {"status": "processing"}, None),
        ("b", "put", {"total": "7", "n": "0"}, None),
        ("c", "put", {"status": "pending", "n": "0"}, None),
        ("c", "delete", None, None),
        ("c", "inc", None, 1),
        ("d", "put", {"status": "pending", "n": "0"}, None),
        ("d", "delete", None, None),
    ])
    st = {r.file_id: r for r in fold(log, ["status", "total"], counter="n").collect()}
    assert set(st) == {"a", "b", "c"}
    assert (st["a"].status, st["a"].total, st["a"].n) == ("processing", "10", 6)
    # second put wipes the status set before it
    assert (st["b"].status, st["b"].total, st["b"].n) == (None, "7", 0)
    # delete then increment: a new record holding only the counter
    assert (st["c"].status, st["c"].n, st["c"].created_at) == (None, 1, None)


def test_progress_replay_idempotent_vs_compat(spark):
    rows = [("a", 1, None, None), ("a", None, 2, None), ("a", None, None, "processing"),
            ("a", 1, None, None), ("a", 1, None, None), ("a", 2, None, None)]
    df = spark.createDataFrame(
        [(f, T0 + dt.timedelta(seconds=i), i, p, t, s) for i, (f, p, t, s) in enumerate(rows)],
        "file_id string, ts timestamp, seq long, page int, total int, status string")
    ours = document_progress(df).first()
    compat = document_progress(df, compat=True).first()
    assert (ours.processed_pages, ours.ready) == (2, True)
    assert (compat.processed_pages, compat.ready) == (4, False)


def test_change_images_and_edges(spark):
    # total 10, status processing, pages 1..10 finished one by one, then a replay of page 3
    rows = [("a", None, 10, None), ("a", None, None, "processing")]
    rows += [("a", p, None, None) for p in range(1, 11)] + [("a", 3, None, None)]
    df = spark.createDataFrame(
        [(f, T0 + dt.timedelta(seconds=i), i, p, t, s) for i, (f, p, t, s) in enumerate(rows)],
        "file_id string, ts timestamp, seq long, page int, total int, status string")
    img = change_images(df, n_segments=4).orderBy("seq").collect()
    assert img[0].op == "INSERT" and all(r.op == "MODIFY" for r in img[1:])
    five = [r for r in img if r.new_processed == 5][0]
    assert (five.old_processed, five.new_total) == (4, 10)
    mods = modify_status_changes(change_images(df, n_segments=4))
    edges = completion_edges(mods).collect()
    assert len(edges) == 1 and edges[0].new_processed == 10 and edges[0].seq == 11
    # level trigger fires on the replay too; the edge does not
    last = img[-1]
    assert (last.old_processed, last.new_processed) == (10, 10)


def test_latest_per_key_and_single_table(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 3, "del")],
                               "k string, v int, s string")
    got = {r.k: r.s for r in latest_per_key(df, ["k"], ["v"], F.col("s") == "del").collect()}
    assert got == {"a": "y"}
    one = single_table(file=df.select("k"), page=df.select("v"))
    assert set(one.columns) == {"k", "v", "kind"} and one.count() == 8


def test_schema_types_are_explicit():
    from quire import schemas
    assert isinstance(schemas.FILES, T.StructType) and "file_id" in schemas.FILES.fieldNames()


def test_replay_fixture_exact(spark):
    """Page 1 sent twice, page 2 once, total 2: processed 2 and ready; literal: 3, not ready."""
    rows = [("a", None, 2, "processing"), ("a", 1, None, None), ("a", 1, None, None),
            ("a", 2, None, None)]
    df = spark.createDataFrame(
        [(f, T0 + dt.timedelta(seconds=i), i, p, t, s) for i, (f, p, t, s) in enumerate(rows)],
        "file_id string, ts timestamp, seq long, page int, total int, status string")
    ours = document_progress(df).first()
    lit = document_progress(df, compat=True).first()
    assert (ours.processed_pages, ours.ready) == (2, True)
    assert (lit.processed_pages, lit.ready) == (3, False)


def test_result_document_shape(spark):
    from quire.operators.manifest import manifest_documents
    pages = spark.createDataFrame([("d1", "t", 2, '{"summary":"x","entities":[]}'),
                                   ("d1", "t", 1, None)],
                                  "file_id string, tenant_id string, page_number int, "
                                  "page_analysis string")
    totals = spark.createDataFrame([("d1", 2)], "file_id string, total_pages int")
    nested = manifest_nested(pages, totals, "2024-02-01 00:00:00")
    row = manifest_documents(nested).first()
    doc = json.loads(row.json)
    assert row.result_key == "t/d1/results.json"
    assert list(doc) == ["fileId", "tenantId", "processedAt", "totalPages", "successCount",
                         "failedCount", "chunks"]
    assert doc["processedAt"] == "2024-02-01T00:00:00.000Z" and doc["totalPages"] == 2
    assert doc["chunks"] == [
        {"pageNumber": 1, "analysis": None, "status": "success"},
        {"pageNumber": 2, "analysis": {"entities": [], "summary": "x"}, "status": "success"}]
    import os
    import tempfile
    from quire.sources.objects import read_result_documents, write_result_documents
    out = os.path.join(tempfile.mkdtemp(prefix="quire-test-"), "docs")
    write_result_documents(manifest_documents(nested), out)
    back = read_result_documents(spark, out).collect()
    assert len(back) == 1 and json.loads(back[0].json) == doc
    assert back[0].result_key == "t/d1/results.json"
