"""Publishing in waves (S9, A4): what a batch call refuses is numbered into new batches and sent
again, a bounded number of times; what is left goes to a dead-letter table.

A wave is one set of Spark jobs over the rest; its outcome is written to the checkpoint folder, so a
lost executor never sends a wave's accepted records again by recomputing them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.publish import BATCH_LIMIT, number_in_batches
from quire.session import checkpoint_root

ATTEMPTS = 4


def publish_with_retries(records: DataFrame, send: Callable[[DataFrame, int], DataFrame],
                         key: Sequence[str], order: Sequence[str], attempts: int = ATTEMPTS,
                         limit: int = BATCH_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, dead letters, totals per attempt).

    ``send(batches, attempt)`` gets the records of a wave with ``batch_id`` and ``batch_index`` and
    returns them with ``error_code`` (null: accepted), the rows it was given. Accepted rows and dead
    letters have the records' columns, ``attempts`` and, if dead, the last ``error_code``. The order
    of the records is kept in every wave.
    """
    checkpoint_root(records.sparkSession)
    columns, key = records.columns, list(key)
    rest, accepted, totals, failed = records, None, None, None
    for attempt in range(1, attempts + 1):
        wave = number_in_batches(rest, key, list(order), limit).drop("chunk_index")
        sent = send(wave, attempt).withColumn("attempts", F.lit(attempt)).checkpoint()
        ok = sent.where("error_code IS NULL").select(*columns, "attempts")
        failed = sent.where("error_code IS NOT NULL").select(*columns, "attempts", "error_code")
        count = sent.groupBy("attempts").agg(
            F.count_distinct(*key, "batch_id").alias("batches"), F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("error_code").isNull()).alias("success_count"),
            F.count_if(F.col("error_code").isNotNull()).alias("failed_count"))
        accepted = ok if accepted is None else accepted.unionByName(ok)
        totals = count if totals is None else totals.unionByName(count)
        if failed.isEmpty():
            break
        rest = failed.select(*columns)
    return accepted, failed, totals
