"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII white space, as the contracts spell it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bucket_count(rows: int, rows_per_bucket: int, least: int) -> int:
    """A power of two of hash buckets that each hold about ``rows_per_bucket`` of ``rows``."""
    need = max(least, math.ceil(rows / rows_per_bucket), 1)
    return 1 << (need - 1).bit_length()


def md5_of(*parts: Column | str) -> Column:
    """Hex MD5 of the parts joined by a slash; strings are literals, a null part reads 'null'."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null"))
            for p in parts]
    return F.md5(F.concat_ws("/", *cols))


def hex_bucket(hex_digest: Column, n: int | Column) -> Column:
    """The first eight hex digits as a number, modulo ``n``."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("bigint") % n


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there. Shuffle files of what came before
    stay on the executors' disks until the driver collects its garbage, so it is asked to."""
    out = df.checkpoint()
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def as_row(df: DataFrame) -> DataFrame:
    """All columns as one struct ``row``, so that helper columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def from_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[field(c).alias(c) for c in columns])


def join_spread(rows: DataFrame, info: DataFrame, keys: list[str], spread: str,
                places: int = 64) -> DataFrame:
    """``rows`` inner-joined with ``info`` (one row per key) without meeting a hot key in one task.

    Rows of a key are spread over ``places`` by a hash of the column ``spread``; what is known of a
    key goes to the places that have it, then to the rows there."""
    rows = (rows.withColumn("_place", F.pmod(F.xxhash64(spread), F.lit(places)).cast("int"))
            .repartition(*keys, "_place"))
    near = rows.select(*keys, "_place").distinct().join(info, keys)
    return rows.join(near, [*keys, "_place"]).drop("_place")


def sample_rows(rows: DataFrame, group: str, key: list[str], limits: dict | int) -> DataFrame:
    """Of every group (named in ``limits``, or any where that is a number) the rows with the
    smallest hash of ``key``, at most and nearly always so many of different key; with nr, from 1.

    Rows of equal key count once, so repeated rows take one place. The groups are few (labels,
    languages): their different keys are counted first, and a bound on the hash leaves about twice
    the rows wanted, so the ranking sees a bounded number of rows per group however many the table
    has."""
    span = 1 << 40
    rows = rows.withColumn("_h", F.pmod(F.xxhash64(*key), F.lit(span)))
    found = rows.groupBy(group).agg(F.approx_count_distinct("_h", 0.02).alias("n")).collect()
    most = {r[group]: limits if isinstance(limits, int) else limits.get(r[group], 0) for r in found}
    bounds = [(g, min(span, span * (2 * most[g] + 64) // max(1, r["n"])), most[g])
              for r in found if most[g := r[group]]]
    here = T.StructType([rows.schema[group], T.StructField("_bound", T.LongType()),
                         T.StructField("_most", T.IntegerType())])
    order = W.partitionBy(group).orderBy("_h")
    return (rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, here)), group)
            .where("_h < _bound").dropDuplicates([group, "_h"])
            .withColumn("nr", F.row_number().over(order)).where("nr <= _most")
            .drop("_h", "_bound", "_most"))
