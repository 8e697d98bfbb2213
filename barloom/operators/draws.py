"""Keyed permutations of row numbers: a draw without replacement is the image of 0, 1, 2, ...

A Feistel network over the smallest even number of bits that holds the size permutes a slightly larger range; numbers outside
are sent through it again until they fall inside (cycle walking), which keeps it a permutation.  A draw is then a row number,
found without looking at the rows, so its cost is that of the rows drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .series import with_position

ROUNDS = 8
DRAW_CHUNK = 4096
BUCKET_ROWS = 50_000


def _stir(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values: two rounds of multiplying by an odd constant and folding the high half down."""
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = x * np.uint64(factor)
        x = x ^ (x >> np.uint64(32))
    return x


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under the permutation of 0 .. size-1 that `key` names; all three have one length."""
    size, key = size.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    bits = np.ceil(np.log2(np.maximum(size, 1).astype(np.float64)) / 2 + 1e-9).astype(np.uint64)
    bits = np.maximum(bits, 1)
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = index.astype(np.uint64)
    todo = np.arange(len(at))
    while len(todo):
        b, m, k = bits[todo], low[todo], key[todo]
        left, right = at[todo] >> b, at[todo] & m
        for turn in range(ROUNDS):
            left, right = right, left ^ (_stir(_stir(right + np.uint64(turn << 48)) ^ k) >> np.uint64(7) & m)
        at[todo] = left << b | right
        todo = todo[at[todo] >= size[todo]]
    return at.astype(np.int64)


@F.pandas_udf(LongType())
def permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(np.int64), size.to_numpy(np.int64), key.to_numpy(np.int64)))


def numbered_rows(rows: DataFrame, by: list[str], size: str, order: list[str], out: str = "_no") -> DataFrame:
    """Adds a number 0 .. size-1 to each row of a group, the same under any partitioning.

    Rows go to buckets by the hash of `order`, about BUCKET_ROWS to each, and are numbered within; a group of any size is
    numbered by as many tasks as it has buckets.
    """
    bucket = F.pmod(F.xxhash64(*order), F.ceil(F.col(size) / F.lit(BUCKET_ROWS)).cast("long"))
    return with_position(rows, tuple(by), list(order), bucket, out)


def drawn_numbers(plan: DataFrame, by: list[str], n: str, size: str, reps: int, seed: int, out: str = "_no") -> DataFrame:
    """(by, rep, out): for each replicate `n` different numbers below `size`, all of them where n is larger.

    plan holds one row per group.  Numbers are made in chunks of DRAW_CHUNK that are dealt over the tasks.
    """
    due = F.least(F.col(n), F.col(size)).cast("long")
    chunk: Column = F.sequence(F.lit(0).cast("long"), F.floor((due - 1) / F.lit(DRAW_CHUNK)))
    work = plan.where(due > 0).withColumn("_due", due).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    work = work.withColumn("_chunk", F.explode(chunk)).repartition(*by, "rep", "_chunk")
    first = F.col("_chunk") * F.lit(DRAW_CHUNK)
    work = work.withColumn("_k", F.explode(F.sequence(first, F.least(first + F.lit(DRAW_CHUNK), F.col("_due")) - 1)))
    key = F.xxhash64(F.lit(seed), F.col("rep"), *by)
    return work.select(*by, "rep", permuted(F.col("_k"), F.col(size).cast("long"), key).alias(out))
