"""Joins of rows to a unique key set that stay parallel when one key has very many rows.

The key rows are repeated over ``PLACES`` and the rows matched on (key, place), the place a hash of
another column of the row. A document with a third of all pages is then matched in many places,
whether or not adaptive execution can split the join (it cannot where an aggregate on the same
key follows or feeds it)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = 16


def _placed(rows: DataFrame, known: DataFrame, keys: Sequence[str],
            spread: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with their place. The key rows are dealt out after they are repeated, so that
    their real size decides whether they are broadcast."""
    known = known.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    return (rows.withColumn("_place", F.pmod(F.xxhash64(spread), F.lit(PLACES)).cast("int")),
            known.repartition(*keys, "_place"))


def semi_spread(rows: DataFrame, known: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Rows whose key is in ``known``."""
    a, b = _placed(rows, known.select(*keys).distinct(), keys, spread)
    return a.join(b, [*keys, "_place"], "left_semi").drop("_place")


def join_spread(rows: DataFrame, known: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Inner join of rows to ``known``, which has one row per key."""
    a, b = _placed(rows, known, keys, spread)
    return a.join(b, [*keys, "_place"]).drop("_place")
