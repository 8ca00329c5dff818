"""A keyed table for lookups (U5): files clustered by key, with min/max statistics and Parquet bloom
filters, and a batch of keys looked up through them.

Rows are range-partitioned and sorted by key, so every row group covers a narrow range. A lookup of
few keys becomes equality filters that the reader checks against statistics and bloom filters before
it reads a row group. A larger batch is a join on the key; its least and greatest key still limit
the files that are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_KEYS = 200          # keys that become filters
ROW_GROUP_BYTES = 8 << 20


def write_keyed(df: DataFrame, path: str, key: str, files: int | None = None,
                distinct: int = 1_000_000, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Writes ``df`` clustered by ``key``; ``distinct`` is the number of keys per file the bloom
    filters are sized for."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    (df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite")
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
     .option("parquet.block.size", str(row_group_bytes)).parquet(path))


def get_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the table at ``path`` whose key is in ``keys`` (its column of the same name).
    Keys that are absent, null or repeated add no rows."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in wanted.limit(FEW_KEYS + 1).collect()]
    table = spark.read.parquet(path)
    if len(some) <= FEW_KEYS:
        if not some:
            return table.where("false")
        # equalities, not IN: a long IN list is pushed down as its range only
        return table.where(reduce(lambda a, b: a | b, [F.col(key) == x for x in sorted(some)]))
    least, most = wanted.agg(F.min(key), F.max(key)).first()
    return (table.where(F.col(key).between(least, most))
            .join(wanted, key, "left_semi"))
