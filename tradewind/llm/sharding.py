"""Sharding: a keyed Feistel permutation of global row numbers, so shard and slot can be computed for any row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import numbered

ROUNDS = 6


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) as the round function."""
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def feistel(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number below n under the permutation of 0..n-1 that seed selects, or its inverse.

    A balanced Feistel network permutes the least power of four that holds n; results at or beyond n are walked
    along their cycle until they fall below n.
    """
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if n <= 1:
        return x.astype(np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = [_mix(np.array([seed & (2**64 - 1)], dtype=np.uint64), np.uint64(r + 1))[0] for r in range(ROUNDS)]
        walking = np.arange(len(x))
        while len(walking):
            y = x[walking]
            left, right = y >> half, y & mask
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mix(left, key) & mask), left
                else:
                    left, right = right, left ^ (_mix(right, key) & mask)
            y = (left << half) | right
            x[walking] = y
            walking = walking[y >= np.uint64(n)]
    return x.astype(np.int64)


def shuffled_place(row_number: Column, n: int, seed: int) -> Column:
    @F.pandas_udf("long")
    def place(s: pd.Series) -> pd.Series:
        return pd.Series(feistel(s.to_numpy(), n, seed))

    return place(row_number)


def shard_of(place: Column, shards: int) -> Column:
    return (place % shards).cast("int")


def slot_of(place: Column, shards: int) -> Column:
    return F.floor(place / shards).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, seed: int = 20_260) -> DataFrame:
    """Every row's shard and slot under the law `rows`: shard sizes differ by one at most, slots have no gap.

    Rows are numbered by ascending id (ties, nulls and repeated rows too: each gets a number of its own), the number
    is permuted, and place p lies in shard p mod shards at slot p div shards. Only id, size and checksum are moved.
    Null texts have size 1 and checksum 0, empty ones too; very long ones count whole. An empty table gives no rows;
    other columns of docs, whatever their names, are not read.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")
    )
    rows = numbered(narrow, ["doc_id", "text_crc32", "size"], "shard-rows")
    n = rows.count()
    placed = rows.withColumn("place", shuffled_place(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard_of(F.col("place"), shards).alias("shard"), slot_of(F.col("place"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
