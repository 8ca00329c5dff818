"""Embedding rows as distinct integer vectors with their number of copies.

A vector travels as the little-endian 64-bit integers of its entries in one binary value, so that
equal vectors are equal bytes and a batch of them is one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 1 << 62       # entries beyond saturate
PART = 4096             # copies of a row that stay together


def _quantised(scale: int, offset: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = pc.is_valid(b["vector"])
            ids, lists = b["id"].filter(there), b["vector"].filter(there)
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            good = np.bincount(row, weights=~np.isfinite(flat), minlength=len(size)) == 0
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.floor(flat[good[row]] * scale), -LONGEST, LONGEST)
            x = x.astype("<i8") + offset
            ends = np.concatenate(([0], np.cumsum(size[good] * 8))).astype(np.int32)
            yield pa.record_batch({
                "id": ids.filter(pa.array(good)),
                "x": pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                           [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])})

    return run


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int,
                     offset: int = 0) -> DataFrame:
    """id, x, copies: the distinct (id, floor(scale * vector) + offset) rows of ``df``. Vectors that
    are null or hold a null or non-finite entry are left out."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("x", T.BinaryType())])
    return (rows.mapInArrow(_quantised(scale, offset), schema)
            .groupBy("id", "x").agg(F.count(F.lit(1)).alias("copies")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The vectors of a binary column as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64) // 8 if len(column) else (
        np.zeros(1, dtype=np.int64))
    data = (np.frombuffer(column.buffers()[2], dtype="<i8", count=ends[-1])[ends[0]:]
            if len(column) and ends[-1] else np.zeros(0, dtype="<i8"))
    size = np.diff(ends)
    width = int(size.max(initial=0)) if width is None else width
    if (size == width).all():
        return data.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)] = data
    return out


def in_parts(df: DataFrame, copies: str = "copies") -> DataFrame:
    """``df`` with a row per ``PART`` of a row's copies: adds ``part`` and ``share``, so that many
    copies can be spread by ``part`` before ``repeated`` writes them out."""
    return (df.withColumn("part", F.explode(F.expr(f"sequence(0L, (`{copies}` - 1) div {PART})")))
            .withColumn("share", F.least(F.lit(PART).cast("bigint"),
                                         F.col(copies) - F.col("part") * PART)))


def repeated(df: DataFrame) -> DataFrame:
    """Every row ``share`` times, without the columns ``part`` and ``share``."""
    return (df.withColumn("_n", F.explode(F.expr("sequence(1L, share)")))
            .drop("_n", "part", "share"))
