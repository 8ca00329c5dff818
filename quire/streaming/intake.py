"""Streaming event intake (ST1, P4, P5).

Raw ``(key, value)`` envelopes arrive as a stream (JSON-line files or Kafka), are strictly
parsed, and each micro-batch is written once, partitioned by ``disposition``: ``process``
(uploads to work on), ``ignore`` (other event types) and ``quarantine`` (text that is not a
valid envelope). A bad record never stops its batch. Output folders are keyed by batch id and
overwritten, so a replayed batch rewrites only itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.publish import parse_envelopes


def _writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (parse_envelopes(batch).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").partitionBy("disposition")
         .parquet(f"{out}/intake/batch_id={batch_id}"))
    return write


def start_intake(wire: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                 interval: str = "2 seconds") -> StreamingQuery:
    """Start the intake of a stream of ``(key, value)`` envelopes."""
    w = wire.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_writer(out))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def intake_table(spark: SparkSession, out: str) -> DataFrame:
    """Everything taken in so far, with its disposition."""
    return spark.read.parquet(f"{out}/intake")
