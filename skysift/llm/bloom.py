"""A blocked Bloom filter whose size is bounded, built on Spark and tested in numpy.

A key is a 64-bit hash. Its high bits choose one block of 256 bits; eight groups of
five low bits choose one bit in each of the block's eight 32-bit words, so a test
touches one cache line. The blocks are or-ed together by a Spark aggregate and only
the finished bitmap reaches the driver. It never grows beyond ``MAX_BLOCKS`` blocks
(16 MB): with more keys than that suits, more of the others pass, never fewer of the
listed ones, and callers settle what passes by an exact join.

Defined cases: no keys give a filter that nothing passes; null keys are not listed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most blocks of 256 bits.
BITS_A_KEY, MAX_BLOCKS = 16, 1 << 19
WORDS = 4


@dataclass
class Bloom:
    shift: int
    blocks: np.ndarray

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        """Which of the 64-bit keys may have been listed."""
        h = keys.astype(np.int64, copy=False).view(np.uint64)
        own = self.blocks[(h >> np.uint64(self.shift)).astype(np.int64)] if self.shift < 64 else np.broadcast_to(self.blocks[0], (len(h), WORDS))
        out = np.ones(len(h), bool)
        for q in range(WORDS):
            mask = (np.uint64(1) << _five(h, 2 * q)) | (np.uint64(1) << (_five(h, 2 * q + 1) + np.uint64(32)))
            out &= (own[:, q] & mask) == mask
        return out


def _five(h: np.ndarray, j: int) -> np.ndarray:
    return (h >> np.uint64(5 * j)) & np.uint64(31)


def _mask(key: Column, q: int) -> Column:
    bit = lambda j: F.shiftright(key, 5 * j).bitwiseAND(31).cast("int")
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), at)
    return one(bit(2 * q)).bitwiseOR(one(bit(2 * q + 1) + 32))


def build(keys: DataFrame, column: str = "h", max_blocks: int = MAX_BLOCKS) -> Bloom:
    """The filter of a column of 64-bit hashes."""
    listed = keys.select(F.col(column).cast("bigint").alias("h")).filter("h is not null")
    blocks = 1
    wanted = min(listed.count() * BITS_A_KEY // 256, max_blocks)
    while blocks < wanted:
        blocks *= 2
    bits = blocks.bit_length() - 1
    place = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")
    words = listed.groupBy(place.alias("block")).agg(*[F.bit_or(_mask(F.col("h"), q)).alias(f"w{q}") for q in range(WORDS)]).toArrow()
    out = np.zeros((blocks, WORDS), np.uint64)
    at = words.column("block").to_numpy()
    for q in range(WORDS):
        out[at, q] = words.column(f"w{q}").to_numpy().view(np.uint64)
    return Bloom(64 - bits, out)
