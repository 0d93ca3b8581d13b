"""A bounded membership test: a bitmap of hashed keys that lets a scan drop rows before a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bitmap's size follows the number of keys up to this many bits (32 MB); beyond, more rows pass than need to.
MOST_BITS = 28
BLOCK = 32_768  # bits of one bitmap of Spark's bitmap functions


def bits_for(n: int, bits_per_key: int = 16) -> int:
    """The logarithm of a bitmap's size for n keys."""
    return min(MOST_BITS, max(15, (max(1, n) * bits_per_key - 1).bit_length()))


def bitmap_of(places: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits with those set that the column p of places names."""
    maps = places.groupBy(F.floor(F.col("p") / BLOCK).alias("b")).agg(F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(BLOCK))).alias("m"))
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    found = maps.toArrow()  # 2^bits / BLOCK rows at most, 32 MB; an iterator would read shuffle files that may be cleaned up by then
    for b, m in zip(found.column("b").to_pylist(), found.column("m").to_pylist(), strict=True):
        bitmap[b * BLOCK // 8 : (b + 1) * BLOCK // 8] = np.frombuffer(m, dtype=np.uint8)
    return bitmap


def is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class MemberTest:
    """Of a column: false only where no key is equal to it; a few others pass too.

    As a column it costs a Python worker of its own; a Python node that reads the texts anyway takes place() as a
    column instead and looks it up with is_set(bitmap.value, ...).
    """

    def __init__(self, keys: DataFrame, key: str):
        self.bits = bits_for(keys.count())
        self.bitmap = keys.sparkSession.sparkContext.broadcast(bitmap_of(keys.select(self.place(F.col(key)).alias("p")), self.bits))

    def place(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("member"), column), F.lit(1 << self.bits))

    def __call__(self, column: Column) -> Column:
        shared = self.bitmap

        @F.pandas_udf("boolean")
        def test(p: pd.Series) -> pd.Series:
            return pd.Series(is_set(shared.value, p.to_numpy()))

        return test(self.place(column))


def member_test(keys: DataFrame, key: str) -> MemberTest:
    """Only the rows that pass need to meet keys in a join, so this never changes a join's result. Broadcast: the
    bitmap, 32 MB at most however many keys there are."""
    return MemberTest(keys, key)
