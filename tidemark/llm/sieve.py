"""Bitmaps of bounded size that tell which hashes may belong to a set: a semi-join's first sieve, exact joins follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23  # 2 ** 23 bits, 1 MB, whatever the set; a crowded bitmap lets more through but drops nothing
MOST_BITS = 27  # 16 MB


def slot(c: Column) -> Column:
    """The position of a value in the bitmap."""
    return F.pmod(F.xxhash64(c), F.lit(1 << BITS))


def _packed(at: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of positions ``s``, eight to a byte; at most 2 ** bits / 32 numbers come to the driver."""
    got = at.groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 32))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return words.view(np.uint8)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """True at the slots of all values of ``column``."""
    return np.unpackbits(_packed(values.select(slot(F.col(column)).alias("s")), BITS), bitorder="little").astype(bool)


class FewestBits:
    """A bitmap over ``n`` 64-bit hashes with about 16 bits each, as far as 2 ** MOST_BITS bits go; its position is the hash's top bits."""

    def __init__(self, hashes: DataFrame, column: str, n: int):
        self.bits = min(MOST_BITS, max(16, (16 * max(1, n) - 1).bit_length()))
        self.packed = _packed(hashes.select(F.shiftrightunsigned(F.col(column), 64 - self.bits).alias("s")), self.bits)


def may_hold(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes may be in the set of a ``FewestBits``."""
    at = hashes >> np.uint64(64 - (len(packed) * 8).bit_length() + 1)
    return (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
