"""Documents larger than a row (M1, S1): pages of a text file read by byte ranges, in parallel, and
numbered by prefix counts.

The text reader cuts a file at the separator nearest to each range, so no task reads a whole
document. Pages are numbered inside their range; one row per range (its number of pages) is summed up
per file, which gives every range the number its pages start at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_large_pages(spark: SparkSession, path: str, sep: str = "\n",
                     range_bytes: int | None = None) -> DataFrame:
    """path, page_number (from 1), page_text, total_pages of the files under ``path``: what
    ``split_pages`` gives for their whole text with a literal one-byte ``sep``. A file that ends
    with the separator has an empty last page, an empty file one empty page. Text is UTF-8.
    ``range_bytes`` is the length of a range (default: the session's ``maxPartitionBytes``)."""
    conf, key = spark.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(key)
    if range_bytes:
        conf.set(key, str(range_bytes))
    try:
        scan = spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(path)
        # scans leave empty files out; the listing, which the driver holds anyway, has them
        names = [re.sub("^file:/+", "file:/", n) for n in scan.inputFiles()]
        lines = (scan.select(F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_block_start").alias("_at"),
                         F.col("_metadata.file_size").alias("_size"),
                         F.monotonically_increasing_id().alias("_row"),
                         F.col("value").alias("page_text")))
        # the ranges are fixed when the scan is planned: written once, so that counts and pages agree
        lines = lines.checkpoint()
    finally:
        conf.set(key, before)
    ranges = lines.groupBy("path", "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"),
        F.sum(F.octet_length("page_text") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    upto = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    ranges = ranges.select(
        "path", "_at", "_first", "_size",
        F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_pages"),
        (F.sum("_bytes").over(whole) == F.col("_size")).alias("_open"))
    starts = ranges.select("path", "_at", "_first", "_before", (
        F.col("_pages") + F.col("_open").cast("int")).alias("total_pages"))
    pages = lines.drop("_size").join(starts, ["path", "_at"]).select(
        "path", (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("int")
        .alias("page_number"), "page_text", F.col("total_pages").cast("int").alias("total_pages"))
    last = ranges.where("_open").select("path", (F.col("_pages") + 1).cast("int").alias("n")).distinct()
    listing = (spark.createDataFrame([(n,) for n in names], "path string")
               .join(ranges.select("path"), "path", "left_anti").withColumn("n", F.lit(1)))
    empty = last.unionByName(listing).select(
        "path", F.col("n").alias("page_number"), F.lit("").alias("page_text"),
        F.col("n").alias("total_pages"))
    return pages.unionByName(empty)
