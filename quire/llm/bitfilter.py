"""A bit per hash slot, for skipping rows that cannot match before a shuffle.

The filter has a fixed largest size (``2**MOST_BITS`` bits, 16 MB), whatever is put in, so it can
be broadcast. A full filter lets everything through: it only ever saves work, the join behind it
decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 27


def bits_for(distinct: int) -> int:
    """log2 of the slots: 32 slots a value, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (32 * max(1, distinct) - 1).bit_length()))


def collect_bits(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter over a bigint column, as bytes; at most ``2**bits / 64`` rows reach the driver."""
    slot = F.shiftrightunsigned(column, 64 - bits)
    parts = (hashes.select(F.shiftrightunsigned(slot, 6).alias("seg"),
                           F.expr("shiftleft(1L, cast({} & 63 as int))".format(
                               f"shiftrightunsigned(`{column}`, {64 - bits})")).alias("bit"))
             .groupBy("seg").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[parts["seg"].to_numpy()] = parts["bits"].to_numpy()
    return out.view(np.uint8)


def may_hold(filter_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For uint64 hashes: False where the value was surely not put in."""
    bits = (len(filter_bytes) * 8 - 1).bit_length()
    slot = hashes >> np.uint64(64 - bits)
    byte = filter_bytes[slot >> np.uint64(3)]
    return (byte >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
