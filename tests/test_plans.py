"""Plan shape of registered queries: the scale properties the README claims, read from the
physical plans Spark chooses (pruned scans, pushed filters, partial top-k, no pair joins)."""

import re

import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(spark, key):
    return registry.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def _read_schemas(plan):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan)


def test_top_k_per_tenant_is_a_window_group_limit(spark):
    # partial top-k in each map partition before the shuffle, not a full sort per tenant
    assert "WindowGroupLimit" in _plan(spark, "tenant_recent_50")


def test_alarm_filter_reaches_the_scan(spark):
    plan = _plan(spark, "error_alarm")
    assert "EqualTo(event_type,error)" in plan
    assert _read_schemas(plan) == ["ts:timestamp_ntz,event_type:string"]


def test_flagship_prunes_columns_and_aggregates_partially(spark):
    plan = _plan(spark, "documents_manifest")
    assert _read_schemas(plan) == ["doc_id:bigint,text:string,source:string"]
    assert plan.count("HashAggregate(") >= 2  # partial + final
    assert "SortAggregate" not in plan


def test_status_views_never_read_text(spark):
    for key in ("job_view", "results_available", "tenant_recent_50", "retention_actions"):
        for schema in _read_schemas(_plan(spark, key)):
            assert "text:" not in schema, key


@pytest.mark.parametrize("key", sorted(k for k in registry.QUERIES if not k.startswith("stream_")))
def test_no_pair_joins(spark, key):
    plan = _plan(spark, key)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("key", ["chunk_batches", "change_images"])
def test_row_windows_are_split_by_segment(spark, key):
    # row-level windows run per (key, segment), so a hot key is spread over many tasks; only
    # the per-segment summary (at most one row per segment and key) is windowed by key alone
    lines = [ln for ln in _plan(spark, key).splitlines() if re.search(r"\bWindow \[", ln)]
    assert lines
    for ln in lines:
        part = re.search(r"\], \[([^\]]*)\], \[", ln)
        if "row_number()" in ln:
            assert part and "_ks_seg" in part.group(1), ln
        else:
            assert "sum(_ks_seg_" in ln, ln
