"""A Bloom filter of bounded size over 64-bit hashes, built by aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW_BITS, HIGH_BITS = 16, 26  # 8 kB to 8 MB


def build(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the filter as 64-bit words; ``column`` holds hashes that are random already.

    16 bits an item up to 8 MB; beyond four million items false positives grow.
    Callers stay right with any number of them. What reaches the driver are the
    words, a million at most.
    """
    n = hashes.count()
    bits = min(max(int(16 * n).bit_length(), LOW_BITS), HIGH_BITS)
    h, mask = F.col(column), F.lit((1 << bits) - 1).cast("long")
    spot = F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)))
    one = F.expr("shiftleft(1L, cast(spot & 63 as int))")
    words = hashes.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(one).alias("x"))
    out = np.zeros(1 << bits - 6, np.uint64)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["x"].to_numpy(np.int64).view(np.uint64)
    return out


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    h, mask = hashes.astype(np.uint64), np.uint64(len(words) * 64 - 1)
    result = np.ones(len(h), bool)
    for spot in (h & mask, (h >> np.uint64(32)) & mask):
        result &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return result
