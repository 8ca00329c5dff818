"""Caller-supplied annotator (mapInPandas, retry rule, placeholder) and object sources/sinks."""

import json
import os


from quire.operators.annotate import annotate_native, annotate_with, call_with_retry
from quire.operators.manifest import manifest_nested
from quire.sources.objects import (
    delete_objects, read_document_headers, read_document_texts, read_documents, read_manifest,
    write_catalog, write_manifests,
)


class Flaky:
    """Fails with the given messages, then answers."""

    def __init__(self, errors, reply='{"summary":"ok"}'):
        self.errors = list(errors)
        self.reply = reply
        self.calls = 0

    def __call__(self, text):
        self.calls += 1
        if self.errors:
            raise RuntimeError(self.errors.pop(0))
        return self.reply


def test_retry_rule():
    waits = []
    f = Flaky(["429 Too Many Requests"])
    assert call_with_retry(f, "t", sleep=waits.append) == ('{"summary":"ok"}', None, 2)
    assert waits == [2.0]
    waits.clear()
    f = Flaky(["429"] * 4)
    reply, err, attempts = call_with_retry(f, "t", sleep=waits.append)
    assert reply is None and "429" in err and attempts == 4 and waits == [2.0, 4.0, 8.0]
    f = Flaky(["500 Internal"])
    assert call_with_retry(f, "t", sleep=waits.append)[1:] == ("500 Internal", 1)


def _annotator(text):
    if "boom" in text:
        raise RuntimeError("500 server error")
    if "cut" in text:
        return '[{"a":1},{"b":2}]'
    return 'Here you go:\n```json\n{"summary": "%s", "entities": []}\n```' % text[:5]


def test_annotate_with_map_in_pandas(spark):
    pages = spark.createDataFrame(
        [("f", 1, "hello world"), ("f", 2, "boom"), ("f", 3, "cut it"), ("g", 1, "fine text")],
        "file_id string, page_number int, page_text string")
    out = annotate_with(pages, _annotator, "2024-02-01 00:00:00", partitions=3,
                        sleep=lambda s: None, prompted=False)
    got = {(r.file_id, r.page_number): json.loads(r.page_analysis) for r in out.collect()}
    assert got[("f", 1)] == {"summary": "hello", "entities": []}
    assert got[("f", 2)] == {"error": "Analysis failed", "timestamp": "2024-02-01T00:00:00.000Z"}
    assert got[("f", 3)]["error"] == "Analysis failed"
    assert got[("g", 1)]["summary"] == "fine "
    assert out.count() == 4


def test_native_annotation_shape(spark):
    pages = spark.createDataFrame([("f", 1, "Alice met Bob in Paris. It was good! Again?  "),
                                   ("f", 2, "")], "file_id string, page_number int, "
                                                  "page_text string")
    got = {r.page_number: json.loads(r.page_analysis)
           for r in annotate_native(pages, "2024-02-01 00:00:00").collect()}
    assert got[1] == {"summary": "Alice met Bob in Paris.", "entities": ["Alice", "Bob", "Paris",
                                                                         "It", "Again"],
                      "keyPoints": ["Alice met Bob in Paris.", "It was good!", "Again?"],
                      "sentiment": "positive"}
    assert got[2] == {"summary": "", "entities": [], "keyPoints": [], "sentiment": "neutral"}


def test_objects_round_trip(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "objects")
    for tenant, fid, name, body in [("t1", "f1", "a.txt", "This is a test PDF content"),
                                    ("t2", "f2", "b.txt", "line one\nline two")]:
        d = os.path.join(root, tenant, fid)
        os.makedirs(d)
        with open(os.path.join(d, name), "w") as fh:
            fh.write(body)
    docs = {r.file_id: r for r in read_documents(spark, root).collect()}
    assert bytes(docs["f1"].content).decode() == "This is a test PDF content"
    assert (docs["f2"].tenant_id, docs["f2"].file_name) == ("t2", "b.txt")
    heads = read_document_headers(spark, root)
    assert "content" not in heads.columns
    assert {r.file_id: r.content_length for r in heads.collect()} == {"f1": 26, "f2": 17}
    texts = {r.file_id: r.text for r in read_document_texts(spark, root, "*.txt").collect()}
    assert texts["f2"] == "line one\nline two"
    cat = spark.createDataFrame([("f1", "application/pdf")], "file_id string, mime_type string")
    typed = {r.file_id: r.content_type
             for r in read_document_headers(spark, root, catalog=cat).collect()}
    assert typed == {"f1": "application/pdf", "f2": None}
    listing = read_document_headers(spark, root)
    gone = delete_objects(listing, listing.filter("file_id = 'f1'"))
    assert [r.file_id for r in gone.collect()] == ["f2"]


def test_catalog_and_manifest_sinks(spark, tmpdir_path):
    files = spark.createDataFrame([("f1", "t1", "a"), ("f2", "t2", "b")],
                                  "file_id string, tenant_id string, file_name string")
    write_catalog(files, os.path.join(tmpdir_path, "files"))
    parts = sorted(d for d in os.listdir(os.path.join(tmpdir_path, "files"))
                   if d.startswith("tenant_id="))
    assert parts == ["tenant_id=t1", "tenant_id=t2"]
    pages = spark.createDataFrame([("f1", "t1", 2, '{"a":1}'), ("f1", "t1", 1, None)],
                                  "file_id string, tenant_id string, page_number int, "
                                  "page_analysis string")
    totals = spark.createDataFrame([("f1", 2)], "file_id string, total_pages int")
    out = os.path.join(tmpdir_path, "results")
    write_manifests(manifest_nested(pages, totals, "2024-02-01 00:00:00"), out)
    raw = open([os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs
                if f.endswith(".json")][0]).read()
    assert '"analysis":null' in raw  # null kept, as the reference writes it
    back = read_manifest(spark, out, "f1").collect()
    assert len(back) == 1 and [c.page_number for c in back[0].chunks] == [1, 2]
    assert back[0].success_count == 1 and back[0].missing_count == 1
    assert read_manifest(spark, out, "nope").count() == 0


def test_results_as_flat_tables(spark, tmpdir_path):
    from quire.operators.manifest import manifest_parts
    from quire.sources.objects import read_result, write_results
    pages = spark.createDataFrame(
        [("f1", "t1", 2, '{"a":1}'), ("f1", "t1", 1, '{"error":"x"}'), ("f2", "t2", 1, "nope")],
        "file_id string, tenant_id string, page_number int, page_analysis string")
    totals = spark.createDataFrame([("f1", 2), ("f2", 1)], "file_id string, total_pages int")
    headers, chunks = manifest_parts(pages, totals, "2024-02-01 00:00:00")
    h = {r.file_id: r for r in headers.collect()}
    assert h["f1"].document_status == "completed" and h["f1"].result_key == "t1/f1/results.json"
    assert h["f2"].document_status == "failed" and h["f2"].result_key is None
    out = os.path.join(tmpdir_path, "results")
    write_results(headers, chunks, out)
    one = read_result(spark, out, "f1", "t1").collect()
    assert len(one) == 1 and [c.status for c in one[0].chunks] == ["failed", "success"]
    assert read_result(spark, out, "f2").count() == 0  # failed documents have no manifest


def test_catalog_overwrite_on_same_key(spark, tmpdir_path):
    import datetime as dt
    from quire.sources.objects import read_catalog
    t0 = dt.datetime(2024, 1, 1)
    path = os.path.join(tmpdir_path, "catalog")
    first = spark.createDataFrame([("f1", "t1", "a.pdf", "uploaded", t0),
                                   ("f2", "t2", "b.pdf", "uploaded", t0)],
                                  "file_id string, tenant_id string, file_name string, "
                                  "status string, updated_at timestamp")
    write_catalog(first, path)
    again = spark.createDataFrame([("f1", "t1", "a2.pdf", "uploaded", t0 + dt.timedelta(hours=1))],
                                  first.schema)
    write_catalog(again, path)
    cur = {r.file_id: r.file_name for r in read_catalog(spark, path).collect()}
    assert cur == {"f1": "a2.pdf", "f2": "b.pdf"}
    plan = read_catalog(spark, path, "t1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan  # only t1's partition is listed
    assert [r.file_id for r in read_catalog(spark, path, "t1").collect()] == ["f1"]


def test_single_expression_annotation_matches_staged(spark):
    from pyspark.sql import functions as F
    from quire.operators.annotate import native_analysis, with_native_analysis
    df = spark.createDataFrame([("Ein guter Tag. Sehr gut!",), ("bad bad good",), ("",)],
                               "t string")
    a = [r.j for r in df.select(F.to_json(native_analysis("t")).alias("j")).collect()]
    b = [r.j for r in with_native_analysis(df, "t", "s").select(F.to_json("s").alias("j"))
         .collect()]
    assert a == b and json.loads(a[1])["sentiment"] == "negative"


def test_decode_and_event_files(spark, tmpdir_path):
    from quire.sources.events import write_events
    from quire.sources.objects import decode_utf8
    df = spark.createDataFrame([(bytearray("héllo".encode()),)], "content binary")
    assert df.select(decode_utf8().alias("t")).first().t == "héllo"
    out = os.path.join(tmpdir_path, "events")
    wire = spark.createDataFrame([("k", '{"eventType":"x"}')], "key string, value string")
    write_events(wire, path=out)
    back = spark.read.schema("key string, value string").json(out).collect()
    assert [(r.key, r.value) for r in back] == [("k", '{"eventType":"x"}')]


def test_bucketed_tables_join_without_shuffle(spark, tmpdir_path):
    from pyspark.sql import functions as F
    from quire.sources.objects import write_bucketed
    a = spark.range(200).select(F.col("id").cast("string").alias("file_id"),
                                (F.col("id") % 3).alias("x"))
    b = spark.range(200).select(F.col("id").cast("string").alias("file_id"),
                                (F.col("id") % 5).alias("y"))
    ta = write_bucketed(a, "quire_test_a", os.path.join(tmpdir_path, "a"), 8)
    tb = write_bucketed(b, "quire_test_b", os.path.join(tmpdir_path, "b"), 8)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ta.join(tb, "file_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


_ACTIVE = {"now": 0}


def _slow_annotator(text):
    """Answers after 50 ms, reporting how many calls of this worker were in flight."""
    import threading
    import time as _t
    lock = _ACTIVE.setdefault("lock", threading.Lock())
    with lock:
        _ACTIVE["now"] += 1
        active = _ACTIVE["now"]
    _t.sleep(0.05)
    with lock:
        _ACTIVE["now"] -= 1
    return '{"summary": "%s", "active": %d}' % (text, active)


def test_annotate_with_concurrency_and_pacing(spark):
    import time as _t
    pages = spark.createDataFrame([("f", i, f"p{i}") for i in range(1, 41)],
                                  "file_id string, page_number int, page_text string")
    out = [json.loads(r.page_analysis) for r in annotate_with(
        pages.coalesce(1), _slow_annotator, "2024-02-01 00:00:00", concurrency=8,
        prompted=False).collect()]
    assert sorted(o["summary"] for o in out) == sorted(f"p{i}" for i in range(1, 41))
    assert max(o["active"] for o in out) > 1  # several requests in flight in one task
    one = [json.loads(r.page_analysis) for r in annotate_with(
        pages.coalesce(1), _slow_annotator, "2024-02-01 00:00:00", prompted=False).collect()]
    assert max(o["active"] for o in one) == 1
    paced = annotate_with(pages.limit(4).coalesce(1), _slow_annotator, "2024-02-01 00:00:00",
                          prompted=False,
                          min_interval=0.2)
    t0 = _t.time()
    assert paced.count() == 4
    assert _t.time() - t0 >= 0.6  # three waits between four request starts


def _batch_annotator(prompts):
    """Answers a list of prompts; refuses lists that hold the word boom."""
    if any("boom" in p for p in prompts):
        raise RuntimeError("500 server error")
    assert all(p.startswith("Analyze the following text") for p in prompts)
    return [json.dumps({"summary": f"{len(prompts)} in a batch"}) for _ in prompts]


def test_annotate_with_a_batch_callable_gets_prompts(spark):
    pages = spark.createDataFrame([("f", i, "boom" if i == 5 else f"text {i}") for i in range(6)],
                                  "file_id string, page_number int, page_text string")
    out = annotate_with(pages.coalesce(1), _batch_annotator, "2024-02-01 00:00:00", batch=2,
                        delay=0.0)
    got = {r.page_number: json.loads(r.page_analysis) for r in out.collect()}
    assert [got[i].get("summary") for i in range(4)] == ["2 in a batch"] * 4
    assert got[4]["error"] == got[5]["error"] == "Analysis failed"
    assert out.columns == [*pages.columns, "attempts", "page_analysis"]


def _headers(spark, rows):
    from quire.operators.manifest import manifest_parts
    pages = spark.createDataFrame(rows, "file_id string, tenant_id string, page_number int, "
                                        "page_analysis string")
    totals = pages.groupBy("file_id").count().withColumnRenamed("count", "total_pages")
    return manifest_parts(pages, totals, "2024-02-01 00:00:00")


def test_writing_a_document_leaves_others_of_its_tenant(spark, tmpdir_path):
    from quire.operators.manifest import manifest_documents, nest_manifest
    from quire.sources.objects import (
        read_result, read_result_documents, read_results, write_result_documents, write_results)
    out = os.path.join(tmpdir_path, "r")
    a, b = _headers(spark, [("a", "t", 1, '{"v":1}')]), _headers(spark, [("b", "t", 1, '{"v":1}')])
    write_results(*a, out, run_id="1")
    write_results(*b, out, run_id="2")
    assert {r.file_id for r in read_results(spark, out)[0].collect()} == {"a", "b"}
    again = _headers(spark, [("a", "t", 1, '{"v":2}'), ("a", "t", 2, "nope")])
    write_results(*again, out, run_id="3")
    write_results(*again, out, run_id="3")      # a retry of the same run
    headers, chunks = read_results(spark, out, tenant_id="t")
    assert {r.file_id: (r.run_id, r.document_status) for r in headers.collect()} == {
        "a": ("3", "failed"), "b": ("2", "completed")}
    assert sorted((r.file_id, r.page_number) for r in chunks.collect()) == [
        ("a", 1), ("a", 2), ("b", 1)]
    assert read_result(spark, out, "a").count() == 0 and read_result(spark, out, "b").count() == 1
    text = os.path.join(tmpdir_path, "text")
    for run, parts in (("1", a), ("2", b)):
        write_result_documents(manifest_documents(nest_manifest(*parts)), text, run, indent=True)
    docs = {r.file_id: r for r in read_result_documents(spark, text).collect()}
    assert docs["a"].result_key == "t/a/results.json"
    assert docs["b"].json == json.dumps(json.loads(docs["b"].json), indent=2)
    manifests = os.path.join(tmpdir_path, "m")
    for run, parts in (("1", a), ("2", b), ("3", a)):
        write_manifests(nest_manifest(*parts), manifests, run_id=run)
    assert sorted(r.file_id for r in read_manifest(spark, manifests).collect()) == ["a", "b"]


def test_indented_json_keeps_values_as_written(spark):
    from quire.functions.jsonrules import indented_json
    for text in ('{"a":[1.0,2e3,"x, {y}"],"b":{},"c":[],"d":null,"e":{"f":"\\"q\\""}}', "[]",
                 '"s"', "[[1],[]]"):
        got = spark.createDataFrame([(text,)], "t string").select(indented_json("t")).first()[0]
        assert json.loads(got) == json.loads(text)
    assert got == "[\n  [\n    1\n  ],\n  []\n]"
