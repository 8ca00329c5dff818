"""Windowed alarms (A5): the sum of a metric per tumbling period, raised when it is strictly
above a threshold. One period decides (no multi-period evaluation).

Batch form here; the streaming form (same windows, watermark-bounded state) is in
``quire.streaming.alarm``. Both group on ``window(ts, period)`` so the map side pre-aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.lifecycle import iso_utc

# Fixed values of the two deployed alarm rules: (name, period, threshold), raised on "> t".
WORKER_ERRORS = ("worker-errors", "5 minutes", 10)
STORE_THROTTLES = ("store-throttles", "5 minutes", 5)


def windowed_counts(events: DataFrame, ts: str, period: str, value: Column | None = None,
                    by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``value`` (default: one per row) per tumbling ``period`` window."""
    v = F.lit(1) if value is None else value
    return (events.groupBy(F.window(F.col(ts).cast("timestamp"), period).alias("w"), *by)
            .agg(F.sum(v).cast("long").alias("metric")))


def alarm_states(counts: DataFrame, threshold: float) -> DataFrame:
    """Flatten windows and mark those strictly above ``threshold``."""
    return counts.select(
        iso_utc(F.col("w.start")).alias("window_start"),
        iso_utc(F.col("w.end")).alias("window_end"),
        *[c for c in counts.columns if c not in ("w", "metric")],
        F.col("metric"), (F.col("metric") > F.lit(threshold)).alias("alarm"))


def error_alarm(events: DataFrame, ts: str = "ts", period: str = WORKER_ERRORS[1],
                threshold: float = WORKER_ERRORS[2], value: Column | None = None) -> DataFrame:
    """Error count (or metric sum) per period and whether the alarm fires."""
    return alarm_states(windowed_counts(events, ts, period, value), threshold)


DEFAULT_RULES = (WORKER_ERRORS, STORE_THROTTLES)


def evaluate_alarms(metrics: DataFrame, rules=DEFAULT_RULES, ts: str = "ts",
                    name: str = "metric_name", value: Column | None = None) -> DataFrame:
    """Evaluate several alarm rules ``(metric name, period, threshold)`` over metric rows
    (name, ts, optional value): one windowed aggregate per rule, unioned, with ``alarm_name``.
    The rules are a fixed, tiny list, so each becomes a pushed-down filter plus a group-by."""
    out = None
    for rule_name, period, threshold in rules:
        part = metrics.filter(F.col(name) == rule_name)
        states = alarm_states(windowed_counts(part, ts, period, value), threshold).withColumn(
            "alarm_name", F.lit(rule_name))
        out = states if out is None else out.unionByName(states)
    return out
