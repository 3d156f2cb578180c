"""A set of 64-bit hashes as a bitmap of fixed size, built by aggregation and shipped to tasks.

It never misses a member. A hash that is no member may pass, the more the fuller the bitmap is, so
whoever asks must stay right if it does; its size does not grow with the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def empty(bits: int = BITS) -> np.ndarray:
    return np.zeros(1 << (bits - 3), np.uint8)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for place in _places(hashes, len(bitmap).bit_length() + 2):
        out &= (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def built(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of column ``h``; partial bitmaps merge by aggregation, at most 2^(bits - 6) rows reach the driver."""

    def cell(place: Column) -> Column:
        return F.struct(F.shiftright(place, 6).alias("at"), F.expr("1L").alias("one"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))

    high = F.shiftrightunsigned("h", 64 - bits)
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    cells = hashes.select(F.explode(F.array(cell(high), cell(low))).alias("c"))
    merged = cells.groupBy("c.at").agg(F.bit_or(F.expr("shiftleft(c.one, c.bit)")).alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[merged["at"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    return words.astype("<u8").view(np.uint8)
