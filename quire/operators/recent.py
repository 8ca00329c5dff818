"""The newest records of every tenant kept current (T1, T2): a bounded index that changes are merged
into, with a refill of the tenants that lose too many.

The index holds the ``k + SLACK`` newest rows of a tenant and, where there are more, the sort key of
its last row: the floor. Everything outside the index is older than the floor, so changes are
compared with the index alone. A tenant that falls below ``k`` rows above its floor is read again
from the full table, that tenant only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 50
SLACK = 50


@dataclass
class RecentIndex:
    """rows: the indexed records; floors: tenant, floor (sort key below which rows are missing)."""

    rows: DataFrame
    floors: DataFrame
    tenant: str
    key: str
    newest: str
    k: int
    slack: int

    def listing(self) -> DataFrame:
        """The ``k`` newest of every tenant, with ``rank``."""
        return _ranked(self.rows, self).where(F.col("rank") <= self.k)


def _ranked(rows: DataFrame, at: RecentIndex) -> DataFrame:
    order = Window.partitionBy(at.tenant).orderBy(F.col(at.newest).desc(), F.col(at.key).asc())
    return rows.withColumn("rank", F.row_number().over(order))


def _cut(rows: DataFrame, floors: DataFrame | None, at: RecentIndex) -> RecentIndex:
    """The newest ``k + slack``; the last of them is the floor where one more row exists."""
    most = at.k + at.slack
    top = _ranked(rows, at).where(F.col("rank") <= most + 1)
    last = (top.groupBy(at.tenant).agg(F.max("rank").alias("n"), F.min(F.when(
        F.col("rank") <= most, F.struct(F.col(at.newest).alias("at"))))["at"].alias("floor")))
    new = last.where(F.col("n") > most).select(at.tenant, "floor")
    if floors is not None:      # a tenant that was cut before stays cut, at the higher floor
        new = (floors.unionByName(new).groupBy(at.tenant).agg(F.max("floor").alias("floor")))
    return RecentIndex(top.where(F.col("rank") <= most).drop("rank"), new, at.tenant, at.key,
                       at.newest, at.k, at.slack)


def build_recent(table: DataFrame, tenant: str = "tenant_id", key: str = "file_id",
                 newest: str = "uploaded_at", k: int = DEFAULT_K, slack: int = SLACK) -> RecentIndex:
    at = RecentIndex(table, table, tenant, key, newest, k, slack)
    return _cut(table, None, at)


def _above(rows: DataFrame, floors: DataFrame, at: RecentIndex) -> DataFrame:
    """Rows strictly newer than their tenant's floor: of the others the index may lack some."""
    known = floors.withColumnRenamed("floor", "_floor")
    return (rows.join(known, at.tenant, "left")
            .where(F.col("_floor").isNull() | (F.col(at.newest) > F.col("_floor"))).drop("_floor"))


def apply_changes(index: RecentIndex, upserts: DataFrame, deleted: DataFrame, table: DataFrame,
                  keep: Column | None = None) -> RecentIndex:
    """The index after changes. ``upserts`` are whole records (one per key), ``deleted`` keys;
    ``table`` is the full table after the same changes, read only for tenants to refill. ``keep``
    is a condition that records must meet (a status filter). A record that moves to another tenant,
    or no longer meets the condition, leaves its old place."""
    at = index
    gone = upserts.select(at.key).union(deleted.select(at.key)).distinct()
    keep = F.lit(True) if keep is None else keep
    some = (index.rows.join(gone, at.key, "left_anti")
            .unionByName(upserts.join(deleted.select(at.key).distinct(), at.key, "left_anti")
                         .where(keep).select(*index.rows.columns)))
    safe = _above(some, index.floors, at)
    count = safe.groupBy(at.tenant).agg(F.count(F.lit(1)).alias("n"))
    short = (index.floors.join(count, at.tenant, "left")
             .where(F.coalesce("n", F.lit(0)) < at.k).select(at.tenant))
    again = (table.where(keep).join(short, at.tenant, "left_semi").select(*index.rows.columns))
    fresh = _cut(safe.join(short, at.tenant, "left_anti"),
                 index.floors.join(short, at.tenant, "left_anti"), at)
    refilled = _cut(again, None, at)
    return RecentIndex(fresh.rows.unionByName(refilled.rows),
                       fresh.floors.unionByName(refilled.floors), at.tenant, at.key, at.newest,
                       at.k, at.slack)
