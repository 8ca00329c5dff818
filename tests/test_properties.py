"""Property tests: strict JSON and truthiness against Python references; order independence."""

import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions.jsonrules import with_outcome, with_parsed
from quire.operators.log import document_progress, fold

json_scalars = (st.none() | st.booleans() | st.integers(-10 ** 6, 10 ** 6)
                | st.floats(allow_nan=False, allow_infinity=False, width=32)
                | st.text(max_size=5))
json_values = st.recursive(json_scalars, lambda inner: st.lists(inner, max_size=3)
                           | st.dictionaries(st.text(max_size=3), inner, max_size=3), max_leaves=6)


def _strict_python(text):
    """Strict parse as a JavaScript JSON.parse would: no NaN/Infinity, one value only."""
    def bad_constant(_):
        raise ValueError("constant")
    try:
        json.loads(text, parse_constant=bad_constant)
        return True
    except (ValueError, RecursionError):
        return False


def _js_truthy(v):
    if v is None or v is False:
        return False
    if v is True:
        return True
    if isinstance(v, (int, float)):
        return v != 0
    if isinstance(v, str):
        return v != ""
    return True  # arrays and objects, even empty


mutations = st.sampled_from(["", "}", "]", ",", " x", "{", '"', "0", "}}", "\n"])


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(json_values, mutations, st.booleans()), min_size=20, max_size=40))
def test_strict_json_matches_python(spark, cases):
    texts = []
    for value, tail, mutate in cases:
        t = json.dumps(value)
        texts.append(t + tail if mutate else t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.ok for r in with_parsed(df, "t", "v")
           .select("i", F.col("v").isNotNull().alias("ok")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _strict_python(t), t


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(json_values, min_size=20, max_size=40))
def test_error_truthiness_matches_javascript(spark, values):
    texts = [json.dumps({"error": v, "other": 1}) for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.o for r in with_outcome(df, "t", "o").collect()}
    for i, v in enumerate(values):
        if isinstance(v, float) and math.isfinite(v) and v != 0 and abs(v) < 1e-300:
            continue  # sub-normal literals: engines may round to 0
        want = "failed" if _js_truthy(v) else "success"
        assert got[i] == want, texts[i]


def test_results_do_not_depend_on_input_order(spark):
    from conftest import SF01
    from quire.plans.inputs import progress_log, status_change_log
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    shuffled = ev.repartition(7, F.xxhash64("props", "event_id"))
    a = document_progress(progress_log(ev))
    b = document_progress(progress_log(shuffled))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    fa = fold(status_change_log(ev), ["tenant_id", "overall_status"], "processed_pages")
    fb = fold(status_change_log(shuffled), ["tenant_id", "overall_status"], "processed_pages")
    assert fa.exceptAll(fb).count() == 0 and fb.exceptAll(fa).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.one_of(st.none(),
                                                                           st.integers(0, 9))),
                min_size=1, max_size=120),
       st.integers(1, 9))
def test_keyed_scan_equals_window(spark, rows, n_segments):
    """Random keys, heavy ties on the leading order column, nulls in the carried value: the
    segmented scan equals one window per key."""
    from pyspark.sql import Window
    from quire.operators.scan import keyed_scan
    data = [(k, t, i, v) for i, (k, t, v) in enumerate(rows)]  # (t, i) unique per key
    df = spark.createDataFrame(data, "k int, t int, i int, v int")
    got = keyed_scan(df, "k", ["t", "i"], sums={"s": F.coalesce("v", F.lit(0))},
                     lasts={"l": "v"}, n_segments=n_segments)
    w = Window.partitionBy("k").orderBy("t", "i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "t", "i", F.row_number().over(w).alias("row_number"),
                     F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("s"),
                     F.last("v", True).over(upto).alias("l"),
                     F.last("v", True).over(before).alias("l_before"))
    cols = ["k", "t", "i", "row_number", "s", "l", "l_before"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b


ops = st.tuples(st.sampled_from(["put", "set", "inc", "delete"]),
                st.dictionaries(st.sampled_from(["a", "b", "n"]), st.integers(0, 9).map(str),
                                max_size=3))


def _replay(seq):
    """Direct replay of a key's operations on one record (the reference's semantics)."""
    rec, created = None, None
    for ts, (op, fields) in enumerate(seq):
        if op == "put":
            rec, created = {f: fields.get(f) for f in ("a", "b", "n")}, ts
        elif op == "set":
            if rec is None:
                rec, created = {"a": None, "b": None, "n": None}, None
            rec.update(fields)
        elif op == "inc":
            if rec is None:
                rec, created = {"a": None, "b": None, "n": None}, None
            rec["n"] = str(int(rec["n"] or 0) + 1)
        else:
            rec, created = None, None
    if rec is None:
        return None
    return (rec["a"], rec["b"], None if rec["n"] is None else int(rec["n"]), created)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from(["k1", "k2", "k3"]), st.lists(ops, min_size=1,
                                                                     max_size=8), min_size=1))
def test_fold_equals_replay(spark, logs):
    import datetime as dt
    from quire.operators.log import fold
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for key, seq in logs.items():
        for i, (op, fields) in enumerate(seq):
            f = None if op in ("inc", "delete") else dict(fields)
            if op == "set" and not f:
                f = {}
            rows.append((key, t0 + dt.timedelta(seconds=i), i, op, f,
                         1 if op == "inc" else None))
    log = spark.createDataFrame(rows, "file_id string, ts timestamp, seq long, op string, "
                                      "fields map<string,string>, inc long")
    got = {r.file_id: (r.a, r.b, r.n, None if r.created_at is None
                       else int((r.created_at - t0).total_seconds()))
           for r in fold(log, ["a", "b"], counter="n").collect()}
    want = {k: v for k, v in ((k, _replay(seq)) for k, seq in logs.items()) if v is not None}
    assert got == want


analyses = st.one_of(
    st.none(), st.just(""), st.just("null"), st.just("{broken"),
    json_values.map(lambda v: json.dumps({"error": v, "summary": "s"})),
    json_values.map(json.dumps))


def _outcome_python(text):
    if text is None or text == "":
        return "missing"
    if not _strict_python(text):
        return "invalid"
    v = json.loads(text)
    if v is None:
        return "invalid"
    if isinstance(v, dict) and _js_truthy(v.get("error")):
        return "failed"
    return "success"


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from(["d1", "d2", "d3"]), st.lists(analyses, min_size=1,
                                                                     max_size=6), min_size=1))
def test_manifest_counts_match_rules(spark, docs):
    from quire.operators.manifest import manifest_header
    rows = [(d, "t", i + 1, a) for d, lst in docs.items() for i, a in enumerate(lst)]
    pages = spark.createDataFrame(rows, "file_id string, tenant_id string, page_number int, "
                                        "page_analysis string")
    got = {r.file_id: (r.success_count, r.failed_count, r.missing_count, r.invalid_count,
                       r.document_status) for r in manifest_header(pages).collect()}
    for d, lst in docs.items():
        outs = [_outcome_python(a) for a in lst]
        want = tuple(outs.count(o) for o in ("success", "failed", "missing", "invalid"))
        status = "failed" if want[3] else "completed"
        assert got[d] == (*want, status), (d, lst)


noise = st.sampled_from(["", "Sure!\n", "```json\n", "\n```", " x ", "}", "{", "[", "]",
                         "null", ",", "\n"])


def _reply_python(reply):
    """Cut from the first '{' to the last '}' across lines, else the whole reply; strict
    parse. Returns the parsed value or the marker for a rejection."""
    import re
    m = re.search(r"\{[\s\S]*\}", reply)
    cand = m.group(0) if m else reply
    if not _strict_python(cand):
        return "<rejected>"
    return json.loads(cand)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(noise, json_values, noise), min_size=10, max_size=30))
def test_reply_extraction_matches_rule(spark, parts):
    from quire.functions.jsonrules import with_reply_parsed
    replies = [a + json.dumps(v) + b for a, v, b in parts]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = {r.i: r.j for r in with_reply_parsed(df, "r", "v")
           .select("i", F.to_json("v").alias("j")).collect()}
    for i, r in enumerate(replies):
        want = _reply_python(r)
        if want == "<rejected>":
            assert got[i] is None, r
        else:
            assert got[i] is not None and json.loads(got[i]) == want, r
