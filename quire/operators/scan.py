"""Ordered per-key scans that stay parallel when one key is huge.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task, so a key
holding a third of the table becomes one task holding a third of the table. ``keyed_scan``
instead computes running values in three steps, all on Spark:

1. Segments: boundaries taken from a hash sample of the rows' whole order positions cut the order
   axis into ``n`` ranges of about equal row count. A position is the tuple of all order columns,
   compared as a window compares it (nulls first, each column in its own type), so many rows with
   one leading value, nulls, large integers, decimals and strings are split like anything else.
   The segment is a deterministic function of the row (a binary search in constant arrays), so
   every branch of the plan agrees on it.
2. Running values within (key, segment) with windows (one hash shuffle on (key, segment)).
3. A per-(key, segment) summary gives each segment its carry-in from the earlier segments of
   the same key (a window over the small summary), joined back on (key, segment) and combined
   with the local values.

Results are the same as the single-window form whatever the boundaries are; these only bound the
work per task, and the sample only places them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A segment holds about this many rows at most (more segments on larger tables), and about so
# many sampled positions decide each boundary.
ROWS_PER_SEGMENT = 4_000_000
SAMPLED_PER_SEGMENT = 16


def _segments_for(df: DataFrame, rows: int, n: int | None) -> int:
    if n:
        return max(1, int(n))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")),
               math.ceil(rows / ROWS_PER_SEGMENT))


def _comparable(df: DataFrame, col: str) -> tuple[Column, str] | None:
    """An order-preserving image of a column in a type that JSON carries exactly, and its type
    name; None for types without one."""
    dt, c = df.schema[col].dataType, F.col(f"`{col}`")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c), "bigint"
    if isinstance(dt, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{col}`)"), "bigint"
    if isinstance(dt, T.DateType):
        return F.unix_date(c), "int"
    if isinstance(dt, T.BinaryType):
        return F.hex(c), "string"
    if isinstance(dt, (T.NumericType, T.StringType, T.BooleanType)):
        return c, dt.simpleString()
    return None


def _images(df: DataFrame, order: Sequence[str]) -> list[tuple[Column, str]]:
    """Images of the leading order columns, up to the first without one."""
    out = []
    for col in order:
        image = _comparable(df, col)
        if image is None:
            break
        out.append(image)
    return out


def _boundaries(df: DataFrame, images: Sequence[tuple[Column, str]], n: int | None,
                keys: Sequence[str]) -> list[dict]:
    """Positions where segments 1, 2, .. start, in order.

    Two jobs over ``df``: its row count, and a sample of about ``SAMPLED_PER_SEGMENT`` positions
    per segment, picked by a hash of keys and position (sorted in one task, being that few)."""
    rows = df.count()
    n = _segments_for(df, rows, n)
    slots = 1 << 30
    share = min(slots, math.ceil(slots * n * SAMPLED_PER_SEGMENT / max(1, rows)))
    known = [F.col(f"`{k}`") for k in keys if k in df.columns]
    picked = F.pmod(F.xxhash64(*known, *[c for c, _ in images]), F.lit(slots)) < share
    names = [f"o{i}" for i in range(len(images))]
    sample = (df.where(picked).select(*[c.alias(x) for x, (c, _) in zip(names, images,
                                                                      strict=True)])
              .repartition(1).sortWithinPartitions(*names).collect())
    at = sorted({round(i * len(sample) / n) for i in range(1, n)} - {0, len(sample)})
    return [sample[i].asDict() for i in at]


def with_segment(df: DataFrame, name: str, order: Sequence[str], n: int | None = None,
                 keys: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Add ``name``, the segment number of each row, non-decreasing in ``order``.

    Boundaries come from ``source`` (default ``df``). A binary search of one projection per halving
    of the stride, which Spark compiles; each holds only the boundaries it can compare with, so
    together they hold every boundary once."""
    source = source if source is not None else df
    images = _images(source, order)
    bounds = _boundaries(source, images, n, keys) if images and n != 1 else []
    out = df.withColumn(name, F.lit(0))
    if not bounds:
        return out
    fields = [f"o{i}" for i in range(len(images))]
    kinds = ", ".join(f"{x}: {kind}" for x, (_, kind) in zip(fields, images, strict=True))
    at = F.col("_segment_at")
    out = out.withColumn("_segment_at", F.struct(*[
        c.alias(x) for x, (c, _) in zip(fields, _images(df, order), strict=False)]))
    for k in reversed(range(len(bounds).bit_length())):
        # here the number is a multiple of 2 ** (k + 1): is boundary number + 2 ** k passed?
        mids = bounds[(1 << k) - 1::1 << (k + 1)]
        table = F.from_json(F.lit(json.dumps(mids, default=str)), f"array<struct<{kinds}>>")
        passed = F.get(table, F.shiftright(name, k + 1)) <= at
        out = out.withColumn(name, F.when(passed, F.col(name) + F.lit(1 << k))
                             .otherwise(F.col(name)))
    return out.drop("_segment_at")


def keyed_scan(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
               sums: Mapping[str, Column | str] | None = None,
               lasts: Mapping[str, Column | str] | None = None,
               n_segments: int | None = None,
               quantile_source: DataFrame | None = None) -> DataFrame:
    """Add running per-key values in ``order`` (ascending; ``order`` must be unique per key).

    ``quantile_source`` is any cheaper DataFrame with the same order columns and about the same
    distribution (e.g. the raw log before enrichment joins); segment boundaries are taken from it.

    Adds ``row_number`` (1-based position within key) and, for every name in
    ``sums``: ``<name>`` = running sum up to and including the row, ``<name>_before`` = before it;
    ``lasts``: ``<name>`` = last non-null value up to and including the row, ``<name>_before``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    sums = dict(sums or {})
    lasts = dict(lasts or {})
    pos = F.struct(*[F.col(c) for c in order])

    base = df
    for name, c in sums.items():
        base = base.withColumn(f"_ks_sv_{name}", F.col(c) if isinstance(c, str) else c)
    for name, c in lasts.items():
        base = base.withColumn(f"_ks_lv_{name}", F.col(c) if isinstance(c, str) else c)

    seg = with_segment(base, "_ks_seg", order, n_segments, keys,
                       quantile_source if quantile_source is not None else df)

    w = Window.partitionBy(*keys, "_ks_seg").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = seg.withColumn("_ks_rn_local", F.row_number().over(w))
    for name in sums:
        local = local.withColumn(f"_ks_s_{name}", F.sum(f"_ks_sv_{name}").over(upto))
    for name in lasts:
        last_upto = F.last(f"_ks_lv_{name}", ignorenulls=True).over(upto)
        local = (local.withColumn(f"_ks_l_{name}", last_upto)
                 .withColumn(f"_ks_lb_{name}",
                             F.last(f"_ks_lv_{name}", ignorenulls=True).over(before)))

    # one row per (key, segment): its size, sums and last non-null values
    aggs = [F.count(F.lit(1)).alias("_ks_seg_n")]
    for name in sums:
        aggs.append(F.sum(f"_ks_sv_{name}").alias(f"_ks_seg_s_{name}"))
    for name in lasts:
        lv = F.col(f"_ks_lv_{name}")
        aggs.append(F.max_by(lv, F.when(lv.isNotNull(), pos)).alias(f"_ks_seg_l_{name}"))
    summary = local.groupBy(*keys, "_ks_seg").agg(*aggs)
    prior = Window.partitionBy(*keys).orderBy("_ks_seg").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.coalesce(F.sum("_ks_seg_n").over(prior), F.lit(0)).alias("_ks_c_n")]
    for name in sums:
        carry_cols.append(F.sum(f"_ks_seg_s_{name}").over(prior).alias(f"_ks_c_s_{name}"))
    for name in lasts:
        carry_cols.append(F.last(f"_ks_seg_l_{name}", ignorenulls=True).over(prior)
                          .alias(f"_ks_c_l_{name}"))
    carry = summary.select(*keys, "_ks_seg", *carry_cols)

    out = local.join(carry, [*keys, "_ks_seg"], "inner")
    out = out.withColumn("row_number", (F.col("_ks_rn_local") + F.col("_ks_c_n")).cast("long"))
    for name in sums:
        total = F.coalesce(F.col(f"_ks_s_{name}"), F.lit(0)) + F.coalesce(F.col(f"_ks_c_s_{name}"),
                                                                       F.lit(0))
        out = (out.withColumn(name, total)
               .withColumn(f"{name}_before", total - F.coalesce(F.col(f"_ks_sv_{name}"), F.lit(0))))
    for name in lasts:
        out = (out.withColumn(name, F.coalesce(F.col(f"_ks_l_{name}"), F.col(f"_ks_c_l_{name}")))
               .withColumn(f"{name}_before",
                           F.coalesce(F.col(f"_ks_lb_{name}"), F.col(f"_ks_c_l_{name}"))))
    drop = [c for c in out.columns if c.startswith("_ks_")]
    return out.drop(*drop)
