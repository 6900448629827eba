"""Bitmaps of hashes: a filter of fixed size, at any size of table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BITS = 1 << 15  # of Spark's own bitmaps


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each value of a one-column table of longs, as
    a bitmap. Spark builds it; at most ``2**bits / 8`` bytes reach the driver."""
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot")
    rows = (
        hashes.select(slot)
        .groupBy(F.expr(f"slot div {ROW_BITS}").alias("at"))
        .agg(F.bitmap_construct_agg(F.expr(f"slot % {ROW_BITS}")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        part, at = np.frombuffer(bytes(row["bits"]), np.uint8), row["at"] * ROW_BITS // 8
        out[at : at + len(part)] = part
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes have their bit set; others are surely absent."""
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
