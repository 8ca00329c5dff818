"""Connected components of an edge table by large-star and small-star rounds (DataFrame only).

Every round is a partial aggregation and a spread join, so a hub with very many edges is no task;
the edges are checkpointed once a round, in the cluster's checkpoint folder, and only a count and
a checksum come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut
from quire.session import checkpoint_root

PLACES = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """edges u, v: adds m, the least of u and all its v. The edges of a node lie in ``PLACES``
    places; what is known of it goes to those that have any."""
    spread = (edges.withColumn("place", F.pmod(F.xxhash64("v"), F.lit(PLACES)).cast("int"))
              .repartition("u", "place"))
    here = spread.groupBy("u", "place").agg(F.min("v").alias("m"))
    least = here.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    there = here.select("u", "place").join(least, "u")
    return spread.join(there, ["u", "place"]).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = _with_least(large.distinct())
    small = (down.select(F.col("v").alias("u"), F.col("m").alias("v"))
             .union(down.select("u", F.col("m").alias("v"))))
    return small.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges u, v of one comparable type, not null. Gives node, label (the least node of its
    component) for every node but the labels themselves. No edges give no rows."""
    checkpoint_root(edges.sparkSession)
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut(edges.distinct())
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
        edges = cut(_round(edges))
