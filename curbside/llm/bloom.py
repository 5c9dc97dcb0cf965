"""Bloom filters of hashes that Spark rows hold, small enough to send to every task.

A filter has as many bits as its items ask for, up to a fixed number, so its size is
bounded. It may take a hash for an item that is none, never the other way round; what
uses one must stay right with such a hash and only does more work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_ITEM = 16
LEAST_BITS, MOST_BITS = 16, 27  # as powers of two: 8 KB to 16 MB
PROBES = 3


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of hashes, all bits depending on all bits."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def joined(*parts: np.ndarray) -> np.ndarray:
    """One hash of several in order."""
    h = np.zeros(1, np.uint64)
    for part in parts:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + part)
    return h


@dataclass
class Bloom:
    words: np.ndarray  # 64 bits each

    def has(self, h: np.ndarray) -> np.ndarray:
        """For each uint64 hash whether it may be an item."""
        mask = np.uint64(64 * len(self.words) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        found = np.ones(len(h), bool)
        for k in range(PROBES):
            place = (h + np.uint64(k) * step) & mask
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & 1 == 1
        return found


def bloom_of(hashes: DataFrame, column: str) -> Bloom:
    """The filter of a column of 64-bit hashes, as signed longs. Its words are made by
    an aggregate; the driver receives no more than the filter."""
    spark: SparkSession = hashes.sparkSession
    items = hashes.count()
    bits = int(np.ceil(np.log2(max(BITS_PER_ITEM * items, 1) + 1)))
    bits = min(max(bits, LEAST_BITS), MOST_BITS)
    mask = (1 << bits) - 1
    low = F.col(column).bitwiseAND(F.lit(mask))
    step = F.shiftrightunsigned(column, 32).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(mask))
    places = [(low + k * step).bitwiseAND(F.lit(mask)) for k in range(PROBES)]
    found = (
        hashes.select(F.explode(F.array(*places)).alias("place"))
        .groupBy(F.shiftright("place", 6).cast("int").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS INT))")).alias("word"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return Bloom(words)
