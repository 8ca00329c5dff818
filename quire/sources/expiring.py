"""Retention carried out (P10, P11): a table laid out by the day its rows expire.

Rows lie in one folder per expiry day. Applying retention deletes the folders of the days that are
over, without reading them, and rewrites the one day that is partly over (dynamic partition
overwrite); files of later days keep their names. Rows to archive are copied to the archive first,
so nothing is lost if the run stops in between, and a second run finishes it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.commits import nothing_there

DAY = "expire_day"


def write_expiring(df: DataFrame, path: str, expires_at: Column, mode: str = "append") -> None:
    """Adds rows under their expiry day (``expires_at`` is a timestamp; null never expires)."""
    day = F.coalesce(F.to_date(expires_at), F.lit("9999-12-31").cast("date"))
    (df.withColumn("expires_at", expires_at).withColumn(DAY, day).repartition(DAY)
     .write.mode(mode).partitionBy(DAY).parquet(path))


def read_expiring(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if nothing_there(e):
            return None
        raise


def _delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def apply_retention(spark: SparkSession, path: str, now: str, archive: str | None = None) -> int:
    """Deletes, or moves to ``archive``, the rows that expire at or before ``now`` (text of a UTC
    timestamp). Returns how many days were dropped whole."""
    table = read_expiring(spark, path)
    if table is None:
        return 0
    at = F.lit(now).cast("timestamp")
    today = F.to_date(at)
    days = [r[0] for r in table.select(DAY).distinct().where(F.col(DAY) <= today).orderBy(DAY)
            .collect()]                     # one row per day, read from folder names
    if not days:
        return 0
    over = table.where(F.col(DAY).isin(days) & (F.col("expires_at") <= at))
    if archive is not None:
        (over.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(DAY).parquet(archive))
    edge = spark.range(1).select(today.cast("date")).first()[0]
    if edge in days:
        rest = table.where((F.col(DAY) == F.lit(edge)) & (F.col("expires_at") > at)).checkpoint()
        if rest.isEmpty():
            _delete_folder(spark, f"{path}/{DAY}={edge}")
        else:
            (rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(DAY).parquet(path))
    whole = [d for d in days if d != edge]
    for d in whole:
        _delete_folder(spark, f"{path}/{DAY}={d}")
    return len(whole)
