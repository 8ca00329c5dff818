"""Edge cases of the JSON rules (strict parse, truthiness, reply extraction)."""

import pytest
from pyspark.sql import functions as F

from quire.functions.jsonrules import (
    page_outcome, parse_reply, reply_json_text, strict_json, with_outcome, with_reply_parsed,
)

OUTCOMES = [
    ('{"error":"x"}', "failed"), ('{"error":"0"}', "failed"), ('{"error":"false"}', "failed"),
    ('{"error":true}', "failed"), ('{"error":[]}', "failed"), ('{"error":{}}', "failed"),
    ('{"error":""}', "success"), ('{"error":null}', "success"), ('{"error":false}', "success"),
    ('{"error":0}', "success"), ('{"error":0.0}', "success"),
    ('{"z":1}', "success"), ('{"ERROR":"x"}', "success"), ("[1]", "success"), ("5", "success"),
    ("null", "invalid"),
    (None, "missing"), ("", "missing"), ("nope", "invalid"),
]


def _outcomes(spark, rows):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    staged = with_outcome(df, "t", "o").select("i", "o")
    single = df.select("i", page_outcome("t").alias("o"))
    a = {r.i: r.o for r in staged.collect()}
    b = {r.i: r.o for r in single.collect()}
    assert a == b
    return [a[i] for i in range(len(rows))]


def test_outcome_truth_table(spark):
    got = _outcomes(spark, [t for t, _ in OUTCOMES])
    assert got == [o for _, o in OUTCOMES]


REPLIES_OK = [
    ('{"a":1}', {"a": 1}),
    ('```json\n{"a":1}\n```', {"a": 1}),
    ('{\n"a":\n1\n}', {"a": 1}),
    ('Sure! {"a":1} hope it helps', {"a": 1}),
    ('[{"a":1}]', {"a": 1}),
    ("[1,2]", [1, 2]),
    ("5", 5),
    ('{"a":1,"a":2}', {"a": 2}),
]
REPLIES_REJECTED = ['[{"a":1},{"b":2}]', '{"a":1} x {"b":2}', '{"a":1}}', "{'a':1}", '{"a":1,}',
                    '{"a":NaN}', '{"a":01}', "nope", "", "   ", "1,2", "NaN"]


def test_reply_extraction(spark):
    import json
    rows = [r for r, _ in REPLIES_OK] + REPLIES_REJECTED
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    staged = with_reply_parsed(df, "r", "v").select("i", F.to_json("v").alias("j"))
    single = df.select("i", F.to_json(parse_reply("r")).alias("j"))
    got = {x.i: x.j for x in staged.collect()}
    assert got == {x.i: x.j for x in single.collect()}
    for i, (_, want) in enumerate(REPLIES_OK):
        assert got[i] is not None, rows[i]
        assert json.loads(got[i]) == want, rows[i]
    for k in range(len(REPLIES_OK), len(rows)):
        assert got[k] is None, rows[k]


def test_null_reply_is_kept_then_fails_document(spark):
    df = spark.createDataFrame([("null",)], "r string")
    row = df.select(strict_json(reply_json_text("r")).isNotNull().alias("ok"),
                    F.is_variant_null(parse_reply("r")).alias("isnull")).first()
    assert row.ok and row.isnull
    assert _outcomes(spark, ["null"]) == ["invalid"]


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('{"a":1},{"b":2}', False),
                                     ("{'a':1}", False), ('"s"', True), ("", False),
                                     ("null]", False), ('{"a":1}]', False), ("5,0]", False),
                                     ("[1],[2]", False), (" 5 ", True), ("[]", True)])
def test_strict_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strict_json("t").isNotNull().alias("ok")).first().ok is ok
