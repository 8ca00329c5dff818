"""Routing, keys, readiness, retention, progress gauge."""

import pytest
from pyspark.sql import functions as F

from quire.functions.keys import object_key, page_sk, path_parts, results_key
from quire.functions.lifecycle import (
    age_days, is_live, or_default, parse_float_prefix, processing_type, progress_percent, ready,
    retention_action, ttl_stamp,
)


@pytest.mark.parametrize("size,thr,want", [
    (10485759, "10", "sync"), (10485760, "10", "async"), (1, "0", "async"), (0, "0", "async"),
    (10 ** 12, "abc", "sync"), (10485760, "10MB", "async"), (10485759, "10MB", "sync"),
    (5, " 0.000004", "async"),
])
def test_routing(spark, size, thr, want):
    df = spark.createDataFrame([(size,)], "s long")
    assert df.select(processing_type("s", thr).alias("p")).first().p == want


def test_parse_float_prefix(spark):
    df = spark.createDataFrame([("10MB",), ("  2.5x",), ("abc",), (".5",), ("-3e2z",)], "t string")
    got = [r.v for r in df.select(parse_float_prefix(F.col("t")).alias("v")).collect()]
    assert got == [10.0, 2.5, None, 0.5, -300.0]


def test_page_keys_pad_never_truncate(spark):
    df = spark.createDataFrame([(1,), (9999,), (10000,)], "n int")
    got = [r.k for r in df.select(page_sk("n").alias("k")).orderBy("n").collect()]
    assert got == ["PAGE#0001", "PAGE#9999", "PAGE#10000"]


@pytest.mark.parametrize("p,t,s,want", [
    (10, 10, "processing", True), (0, 0, "processing", False), (9, 10, "processing", False),
    (11, 10, "processing", False), (10, 10, "aggregating", False), (10, 10, "completed", False),
    (None, 10, "processing", False),
])
def test_ready(spark, p, t, s, want):
    df = spark.createDataFrame([(p, t, s)], "p int, t int, s string")
    assert df.select(ready("p", "t", "s").alias("r")).first().r is want


def test_retention_edges(spark):
    df = spark.createDataFrame([(89,), (90,), (29,), (30,)], "a int")
    got = df.select(retention_action("a", "document").alias("d"),
                    retention_action("a", "result").alias("r")).collect()
    assert [(r.d, r.r) for r in got] == [("keep", "archive"), ("expire", "archive"),
                                         ("keep", "keep"), ("keep", "archive")]


def test_ttl_and_age(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "ts string").select(
        F.col("ts").cast("timestamp").alias("ts"))
    row = df.select(ttl_stamp(F.col("ts"), 90).alias("ttl"),
                    age_days("ts", F.lit("2024-04-01 00:00:00")).alias("age")).first()
    assert row.ttl == 1704067200 + 90 * 86400
    assert row.age == 91
    live = df.select(is_live(F.lit(row.ttl), F.lit("2024-03-30 23:59:59")).alias("a"),
                     is_live(F.lit(row.ttl), F.lit("2024-03-31 00:00:00")).alias("b")).first()
    assert live.a is True and live.b is False


def test_or_default_and_paths(spark):
    df = spark.createDataFrame([("",), (None,), ("b",)], "b string")
    got = [r.v for r in df.select(or_default("b", "dflt").alias("v")).collect()]
    assert got == ["dflt", "dflt", "b"]
    one = spark.createDataFrame([("t1", "f1", "x.pdf")], "t string, f string, n string")
    r = one.select(object_key("t", "f", "n").alias("k"), results_key("t", "f").alias("rk")).first()
    assert r.k == "t1/f1/x.pdf" and r.rk == "t1/f1/results.json"
    parts = one.select(path_parts(F.lit("s3://bucket/root/t1/f1/x.pdf"))[0].alias("t")).first()
    assert parts.t == "t1"


def test_progress_percent(spark):
    df = spark.createDataFrame([(1, 3), (None, 4), (2, 0), (2, None)], "p int, t int")
    got = [r.v for r in df.select(progress_percent("p", "t").alias("v")).collect()]
    assert got == [33.33, 0.0, None, None]


def test_index_keys_and_int_prefix(spark):
    from quire.functions.keys import chunk_partition_key, file_index_keys, status_index_keys
    from quire.functions.lifecycle import parse_int_prefix
    df = spark.createDataFrame([("t", "f", "2024-01-01 00:00:00")], "t string, f string, ts string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    fk, fs = file_index_keys("t", "ts")
    sk, ss = status_index_keys("t", "ts")
    r = df.select(fk.alias("a"), fs.alias("b"), sk.alias("c"), ss.alias("d"),
                  chunk_partition_key("t", "f").alias("e")).first()
    assert (r.a, r.b) == ("TENANT#t", "FILE#2024-01-01T00:00:00.000Z")
    assert (r.c, r.d, r.e) == ("TENANT#t#STATUS", "2024-01-01T00:00:00.000Z", "t#f")
    nums = spark.createDataFrame([("10",), (" 7pages",), ("x1",), ("-3",)], "s string")
    assert [x.v for x in nums.select(parse_int_prefix(F.col("s")).alias("v")).collect()] == [
        10, 7, None, -3]
