"""Alarm state changes (A5, ST8): OK and ALARM edges over a window axis without gaps.

A window without a row counts zero, so an alarm ends when the errors stop. The axis of a rule runs
from its first to its last window; its size follows time, not the number of events. The state
before the first window is OK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OK, ALARM = "OK", "ALARM"


def full_axis(counts: DataFrame, period: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts: window_start (timestamp), metric, ``by`` columns; one row per window of the axis of
    every group, metric 0 where there was none."""
    ends = counts.groupBy(*by).agg(F.min("window_start").alias("_a"), F.max("window_start").alias("_z"))
    axis = ends.select(*by, F.explode_outer(F.expr(
        f"sequence(_a, _z, INTERVAL {period})")).alias("window_start")).where(
            "window_start IS NOT NULL")
    return (axis.join(counts, [*by, "window_start"], "left")
            .select(*by, "window_start", F.coalesce("metric", F.lit(0)).cast("long").alias("metric")))


def alarm_transitions(counts: DataFrame, period: str, threshold: float,
                      by: tuple[str, ...] = ()) -> DataFrame:
    """The windows at which the state changes: ``by`` columns, window_start, metric, from_state,
    to_state, lasted (windows the state before had held)."""
    axis = full_axis(counts, period, by).withColumn(
        "to_state", F.when(F.col("metric") > threshold, F.lit(ALARM)).otherwise(F.lit(OK)))
    # windows of time per rule: bounded by the span of time, however many events there are
    line = Window.partitionBy(*by).orderBy("window_start")
    at = axis.withColumn("_n", F.row_number().over(line)).withColumn(
        "from_state", F.lag("to_state", 1, OK).over(line)).where("from_state != to_state")
    return (at.withColumn("lasted", (F.col("_n") - F.lag("_n", 1, 1).over(line)).cast("long"))
            .select(*by, "window_start", "metric", "from_state", "to_state", "lasted"))
