"""Skew-safe keyed scan, batching, publish report, intake, alarms."""

import datetime as dt
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators.alarm import error_alarm
from quire.operators.publish import (
    BATCH_TOO_LARGE, chunk_events, envelope, merge_fields, merge_payload, number_in_batches,
    parse_envelopes, publish_report, typed_map,
)
from quire.operators.scan import keyed_scan, with_segment

T0 = dt.datetime(2024, 1, 1)


def test_keyed_scan_matches_window_under_skew(spark):
    # key 0 holds a third of the rows; values and nulls to carry across segments
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        (F.col("id") * 7 % n).alias("o"),
        F.when(F.col("id") % 11 == 0, F.col("id")).alias("x"),
        (F.col("id") % 5).alias("y"))
    got = keyed_scan(df, "k", ["o"], sums={"s": "y"}, lasts={"l": "x"}, n_segments=16)
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "o", F.row_number().over(w).alias("row_number"),
                     F.sum("y").over(upto).alias("s"),
                     F.coalesce(F.sum("y").over(before), F.lit(0)).alias("s_before"),
                     F.last("x", True).over(upto).alias("l"),
                     F.last("x", True).over(before).alias("l_before"))
    cols = ["k", "o", "row_number", "s", "s_before", "l", "l_before"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.count() == n
    # the hot key is spread: no (key, segment) group holds more than ~n/16 * 2 rows
    seg = with_segment(df, "seg", ["o"], 16)
    biggest = seg.groupBy("k", "seg").count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * n // 16


def test_batches_of_500(spark):
    sizes = {"a": 0, "b": 500, "c": 501, "d": 1000}
    rows = [(k, i) for k, m in sizes.items() for i in range(m)]
    df = spark.createDataFrame(rows or [("x", 0)], "doc string, page int")
    b = number_in_batches(df, "doc", ["page"], n_segments=4)
    got = {r.doc: r.n for r in b.groupBy("doc").agg(F.countDistinct("batch_id").alias("n"))
           .collect()}
    assert got == {"b": 1, "c": 2, "d": 2}
    assert b.filter("doc = 'c' AND chunk_index = 501").first().batch_id == 1


def test_publish_report(spark):
    recs = spark.createDataFrame([("t", 0, i) for i in range(3)],
                                 "tenant string, batch_id long, batch_index int")
    ok = recs.withColumn("error_code", F.lit(None).cast("string"))
    totals, failed = publish_report(recs, ok, ["tenant"])
    r = totals.first()
    assert (r.records, r.success_count, r.failed_count, r.error) == (3, 3, 0, None)
    big = spark.createDataFrame([("t", 0, i) for i in range(600)],
                                "tenant string, batch_id long, batch_index int")
    out = big.withColumn("error_code", F.when(F.col("batch_index") == 5, F.lit("Throttled")))
    totals, failed = publish_report(big, out, ["tenant"])
    r = totals.first()
    assert r.error == BATCH_TOO_LARGE and r.success_count is None
    totals, failed = publish_report(recs, recs.withColumn(
        "error_code", F.when(F.col("batch_index") == 1, F.lit("Throttled"))), ["tenant"])
    assert (totals.first().failed_count, failed.count()) == (1, 1)


def test_intake_parse(spark):
    base = spark.createDataFrame([(1, "t", "f1", ""), (2, "t", "f2", "b2"), (3, "t", "f3", "")],
                                 "seq int, tenant string, file string, bucket string")
    data = merge_payload(F.create_map(F.lit("fileId"), F.col("file"), F.lit("tenantId"),
                                      F.col("tenant")),
                         F.create_map(F.lit("s3Key"), F.lit("k"), F.lit("bucket"), F.col("bucket"),
                                      F.lit("fileId"), F.concat(F.lit("o"), F.col("file"))))
    wire = base.select("seq", envelope(F.when(F.col("seq") == 3, F.lit("chunk.ready"))
                                       .otherwise(F.lit("document.uploaded")), data,
                                       F.lit(T0)).alias("value"))
    broken = spark.createDataFrame([(9, '{"eventType":"document.uploaded"'),
                                    (10, '{"eventType":"document.uploaded","data":5}')],
                                   "seq int, value string")
    got = {r.seq: r for r in parse_envelopes(wire.unionByName(broken)).collect()}
    assert got[1].disposition == "process" and got[1].bucket == "pdfs"
    assert got[1].file_id == "of1"  # later keys overwrite: the payload's fileId wins
    assert got[2].bucket == "b2"
    assert got[3].disposition == "ignore"
    assert got[9].disposition == "quarantine" and got[10].disposition == "quarantine"


def test_chunk_events(spark):
    pages = spark.createDataFrame([("f", "t", 1)], "file_id string, tenant_id string, "
                                                   "page_number int")
    r = chunk_events(pages, F.lit(T0)).first()
    assert r.key == "t#f" and '"eventType":"chunk.ready"' in r.value


def test_alarm_rules(spark):
    def run(offsets):
        df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in offsets],
                                   "ts timestamp")
        return [(r.metric, r.alarm) for r in error_alarm(df, "ts", "5 minutes", 10)
                .orderBy("window_start").collect()]
    assert run(range(10)) == [(10, False)]
    assert run(range(11)) == [(11, True)]
    assert run([294, 295, 296, 297, 298, 299, 300, 301, 302, 303, 304, 305]) == [
        (6, False), (6, False)]


def test_both_deployed_alarm_rules(spark):
    from quire.operators.alarm import evaluate_alarms
    rows = ([("worker-errors", T0 + dt.timedelta(seconds=i)) for i in range(11)]
            + [("store-throttles", T0 + dt.timedelta(seconds=i)) for i in range(6)]
            + [("store-throttles", T0 + dt.timedelta(minutes=10, seconds=i)) for i in range(5)])
    df = spark.createDataFrame(rows, "metric_name string, ts timestamp")
    got = sorted((r.alarm_name, r.window_start, r.metric, r.alarm)
                 for r in evaluate_alarms(df).collect())
    assert got == [("store-throttles", "2024-01-01T00:00:00.000Z", 6, True),
                   ("store-throttles", "2024-01-01T00:10:00.000Z", 5, False),
                   ("worker-errors", "2024-01-01T00:00:00.000Z", 11, True)]


def test_change_images_exact_with_a_hot_document(spark):
    """A third of all events belong to one document: the segmented scan must still give the
    same images as a single window per document."""
    from conftest import SF01
    from quire.operators.log import change_images
    from quire.plans.inputs import progress_log
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    log = progress_log(ev).withColumn(
        "file_id", F.when(F.col("seq") % 3 == 0, F.lit(-1)).otherwise(F.col("file_id")))
    got = change_images(log, n_segments=12).select(
        "file_id", "seq", "op", "old_processed", "old_total", "old_status", "new_processed",
        "new_total", "new_status")
    log.createOrReplaceTempView("hot_log")
    want = spark.sql("""
      WITH f AS (
        SELECT *, CASE WHEN page IS NOT NULL AND row_number() OVER (
            PARTITION BY file_id, page ORDER BY ts, seq) = 1 THEN 1 ELSE 0 END AS is_first
        FROM hot_log),
      s AS (
        SELECT *, sum(is_first) OVER w AS new_processed,
          last(total, true) OVER w AS new_total, last(status, true) OVER w AS new_status,
          row_number() OVER (PARTITION BY file_id ORDER BY ts, seq) AS rn
        FROM f WINDOW w AS (PARTITION BY file_id ORDER BY ts, seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      SELECT file_id, seq, CASE WHEN rn = 1 THEN 'INSERT' ELSE 'MODIFY' END AS op,
        new_processed - is_first AS old_processed,
        lag(new_total) OVER p AS old_total, lag(new_status) OVER p AS old_status,
        new_processed, new_total, new_status
      FROM s WINDOW p AS (PARTITION BY file_id ORDER BY ts, seq)""")
    assert got.count() == want.count() == ev.count()
    assert got.exceptAll(want).count() == 0
    hot = got.filter("file_id = -1").count()
    assert hot > ev.count() // 4


def test_keyed_scan_splits_a_heavy_tie(spark):
    """Half of all rows share one timestamp (and one key): the second order column splits them,
    and the result still equals a single window."""
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(1000)).otherwise(F.col("id")).alias("ts"),
        F.col("id").alias("seq"), (F.col("id") % 7).alias("y"))
    got = keyed_scan(df, "k", ["ts", "seq"], sums={"s": "y"}, n_segments=16)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = df.select("k", "ts", "seq", F.row_number().over(w).alias("row_number"),
                     F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    cols = ["k", "ts", "seq", "row_number", "s"]
    assert got.select(*cols).exceptAll(want).count() == 0 and got.count() == n
    seg = with_segment(df, "seg", ["ts", "seq"], 16)
    biggest = seg.groupBy("k", "seg").count().agg(F.max("count")).first()[0]
    assert biggest <= 2 * n // 16
    # segments never decrease along the order
    ordered = seg.orderBy("ts", "seq").select("seg").collect()
    assert all(a.seg <= b.seg for a, b in zip(ordered, ordered[1:]))


def test_keyed_scan_with_many_segments(spark):
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("k"),
        ((F.col("id") * 7919) % n).alias("o"), (F.col("id") % 5).alias("y"))
    got = keyed_scan(df, "k", ["o"], sums={"s": "y"}, n_segments=600)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.row_number().over(w).alias("row_number"),
                     F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    cols = ["k", "o", "row_number", "s"]
    assert got.select(*cols).exceptAll(want).count() == 0 and got.count() == n


def _same_as_window(df, order, n_segments):
    got = keyed_scan(df, "k", order, sums={"s": "y"}, n_segments=n_segments)
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("k", *order, F.row_number().over(w).alias("row_number"),
                     F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    cols = ["k", *order, "row_number", "s"]
    assert got.count() == df.count()
    assert got.select(*cols).exceptAll(want).count() == 0


def test_keyed_scan_orders_any_type_as_a_window_does(spark):
    n = 2000
    base = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("k"),
        F.col("id").alias("i"), (F.col("id") % 5).alias("y"))
    far = F.lit(1 << 60) + F.col("i") * 3 % n
    for o in (F.when(F.col("i") % 10 != 0, F.col("i") * 7 % n),                 # nulls first
              far.cast("bigint"), far.cast("decimal(38,4)"),                     # beyond a double
              F.md5(F.col("i").cast("string")), F.lit("one"), F.lit(None).cast("string"),
              F.col("i").cast("double") / 3, F.lit("2024-01-01").cast("date"),
              F.md5(F.col("i").cast("string")).cast("binary"),
              F.timestamp_micros(F.col("i") * 77777), F.col("i") % 2 == 0):
        _same_as_window(base.withColumn("o", o), ["o", "i"], 12)


def test_many_tied_values_are_all_split(spark):
    """100 leading values of 400 rows each in one key: no group above twice the target."""
    df = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") % 100).alias("o"),
                                    F.col("id").alias("i"), F.lit(1).alias("y"))
    seg = with_segment(df, "seg", ["o", "i"], 400, ["k"])
    assert seg.groupBy("k", "seg").count().agg(F.max("count")).first()[0] <= 300
    _same_as_window(df, ["o", "i"], 50)


def test_replayed_log_does_not_overcount(spark):
    """A second run of a 3-page document whose sequence numbers start again."""
    from quire.operators.log import change_images, completion_edges
    one = [(1, 0, None, None, "processing"), (1, 1, None, 3, None), (1, 2, 1, None, None),
           (1, 3, 2, None, None), (1, 4, 3, None, None)]
    rows = [("f", T0 + dt.timedelta(days=run), seq, page, total, status)
            for run in (0, 1) for _, seq, page, total, status in one]
    log = spark.createDataFrame(rows, "file_id string, ts timestamp, seq long, page int, "
                                      "total int, status string")
    images = change_images(log)
    assert images.agg(F.max("new_processed")).first()[0] == 3
    assert completion_edges(images).count() == 1


def test_fold_of_a_hot_key_is_spread(spark):
    """One document holds a third of the log, most of it increments: its counter is right, and
    no row-level group holds more than a few segments' worth."""
    from quire.operators.log import fold
    n = 6000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("file_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") == 3000, F.lit("put")).otherwise(F.lit("inc")).alias("op"),
        F.when(F.col("id") == 3000, F.create_map(F.lit("n"), F.lit("5"))).alias("fields"),
        F.lit(1).cast("long").alias("inc"))
    got = {r.file_id: (r.n, r.ops) for r in fold(log, [], "n", n_segments=16).collect()}
    assert got["hot"] == (5 + 999, 2000) and got["d1"][0] == got["d1"][1]
    seg = with_segment(log, "seg", ["ts", "seq"], 16, ["file_id"])
    assert seg.groupBy("file_id", "seg").count().agg(F.max("count")).first()[0] <= 2 * n // 16


def test_set_with_a_null_value_keeps_the_field(spark):
    from quire.operators.log import fold
    rows = [("f", T0, 0, "put", {"overall_status": "pending", "n": "2"}, None),
            ("f", T0, 1, "set", {"overall_status": None, "n": None}, None)]
    log = spark.createDataFrame(rows, "file_id string, ts timestamp, seq long, op string, "
                                      "fields map<string,string>, inc long")
    r = fold(log, ["overall_status"], "n").first()
    assert (r.overall_status, r.n) == ("pending", 2)


def test_payload_merges(spark):
    """Later payloads win, a null one changes nothing; the map and the struct form agree."""
    df = spark.createDataFrame([("f1", None, None), ("f2", "g2", 3)],
                               "fid string, own string, page int")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    payload = F.when(F.col("own").isNotNull(), typed_map(fileId=F.col("own"),
                                                         pageNumber=F.col("page")))
    maps = merge_payload(typed_map(fileId=F.col("fid"), tenantId=F.lit("t")), payload)
    structs = merge_fields({"fileId": F.col("fid"), "tenantId": F.lit("t")},
                           {"fileId": F.col("own"), "pageNumber": F.col("page")})
    got = [[json.loads(x)["data"] for x in r] for r in df.select(
        envelope(F.lit("e"), maps, ts), envelope(F.lit("e"), structs, ts)).collect()]
    assert got == [[{"fileId": "f1", "tenantId": "t"}] * 2,
                   [{"fileId": "g2", "tenantId": "t", "pageNumber": 3}] * 2]


def test_intake_dispositions(spark):
    """What is an envelope: strict JSON objects with any white space before them; an upload needs
    a data object. Types of asked fields come along."""
    texts = [' \t\n{"eventType":"document.uploaded","data":{"fileId":"a","bucket":"","n":1}}',
             '{"eventType":"document.uploaded","data":[1]}', '{"eventType":"x"}', '[{"a":1}]',
             '"{"', '{"a":1} x', '{"a":1},{"b":2}', 'null', '', None, '{']
    wire = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = parse_envelopes(wire, typed_fields=("n",)).orderBy("i").collect()
    assert [r["disposition"] for r in got] == ["process", "quarantine", "ignore",
                                               *["quarantine"] * 8]
    assert (got[0]["file_id"], got[0]["n_type"]) == ("a", "BIGINT") and got[0]["bucket"]
    assert all(r["n_type"] is None for r in got[1:])
