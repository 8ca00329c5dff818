"""Streaming error alarm (ST8): tumbling-window counts with a watermark that bounds state.

Same windows and rule as the batch form (``quire.operators.alarm``). Update mode: each batch
emits the windows it changed; the final state of a window is its last update. Without a
watermark (the default) no row is ever too late and the state is one count per window. With one,
Spark drops rows later than it, and the state of old windows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.log import latest_per_key
from quire.session import start_with_partitions


def error_windows(events: DataFrame, period: str, watermark: str | None = None,
                  ts: str = "ts") -> DataFrame:
    ev = events.withColumn("_ets", F.col(ts).cast("timestamp"))
    ev = ev.withWatermark("_ets", watermark) if watermark else ev
    return ev.groupBy(F.window("_ets", period).alias("w")).agg(
        F.count(F.lit(1)).cast("long").alias("metric"))


def _writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("w.start").alias("window_start_ts"),
                      F.col("w.end").alias("window_end_ts"), "metric",
                      F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{out}/updates/batch_id={batch_id}"))
    return write


def start_alarm(errors: DataFrame, out: str, checkpoint: str, period: str = "5 minutes",
                watermark: str | None = None, available_now: bool = True,
                state_partitions: int | None = None) -> StreamingQuery:
    w = (error_windows(errors, period, watermark).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint).foreachBatch(_writer(out)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return start_with_partitions(w, errors.sparkSession, state_partitions)


def final_windows(spark: SparkSession, out: str) -> DataFrame:
    ups = spark.read.parquet(f"{out}/updates")
    return latest_per_key(ups, ["window_start_ts"], ["batch_id"])
