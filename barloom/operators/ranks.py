"""Percentile ranks of a value within its own past.

Both are dominance counts.  Rows are placed by time position and, for the expanding rank, also by
value; every Python group is one block, however long the series is, and counts with arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import BUCKET_SECONDS, Series, keep_own, split, time_bucket, with_position

#: A series is cut into this many blocks of time at most, and at this many quantiles of its values.
TIME_BLOCKS = 1024
VALUE_CUTS = 255


def _earlier_and_lower(values: np.ndarray) -> np.ndarray:
    """For each of `values`, in order of time: how many earlier ones are smaller.

    Bottom-up merging: at width w every right half of 2 * w rows counts its left half, and all pairs of halves are sorted at once.
    """
    n = len(values)
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-at, values))] = at  # the later of two equal values comes first, so neither counts the other
    out = np.zeros(n, np.int64)
    width = 1
    while width < n:
        pair = at // (2 * width)
        order = np.argsort(pair * n + rank, kind="stable")
        left = at[order] // width % 2 == 0
        before = np.cumsum(left) - pair[order] * width  # all pairs before are whole, so each had `width` left rows
        out[order[~left]] += before[~left]
        width *= 2
    return out


def _like(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def expanding_rank(
    df: DataFrame,
    s: Series,
    value: str,
    out: str,
    min_obs: int = 250,
    block_rows: int = 65_536,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Share of strictly earlier values that are smaller; NULL before `min_obs` of them.

    A series of up to `block_rows` rows is one block.  A longer one is cut along time and along its values.  What is earlier
    and lower is then in the row's own block of time, or in its own block of values at an earlier block of time, or in
    cells earlier and lower, which come from sums over the cells.  Values are cut at quantiles; a value that is
    a cut itself has a block of its own, where nothing is lower, so a value that very many rows share costs nothing.
    """
    keys = list(s.keys)
    base = df.where(F.col(value).isNotNull())
    base = with_position(base, s.keys, [s.ts], time_bucket(s.ts, bucket_seconds), "_t")
    at = F.array(*[F.lit(i / (VALUE_CUTS + 1)) for i in range(1, VALUE_CUTS + 1)])
    sizes = base.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, at, 20 * VALUE_CUTS).alias("_q"))
    per_block = F.greatest(F.lit(block_rows), F.ceil(F.col("_n") / TIME_BLOCKS))
    sizes = sizes.withColumn("_per", per_block).withColumn("_every", F.greatest(F.lit(1), F.floor((VALUE_CUTS + 1) * F.col("_per") / F.col("_n"))))
    # about as many cuts of the values as blocks of time, none where one block holds all
    cuts = F.when(F.col("_n") > block_rows, F.filter("_q", lambda _, i: (i + 1) % F.col("_every") == 0)).otherwise(F.array())
    sizes = sizes.select(*keys, "_per", cuts.alias("_q"))
    below, exact = F.size(F.filter("_q", lambda x: x < F.col(value))), F.array_contains("_q", F.col(value))
    pos = base.select(*keys, "_t", value).join(sizes, keys)
    pos = pos.select(
        *keys, "_t", F.col(value).alias("_x"), F.floor(F.col("_t") / F.col("_per")).alias("_tb"),
        F.when(F.size("_q") > 0, 2 * below + F.when(exact, 1).otherwise(0)).alias("_vb"),
    )

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        return pdf.assign(_below=_earlier_and_lower(pdf["_x"].to_numpy()))

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t")
        x, tb = pdf["_x"].to_numpy(), pdf["_tb"].to_numpy()
        # with earlier blocks of time lifted above later ones, only rows of the same block are left to count
        place = np.unique(x, return_inverse=True)[1]
        same = _earlier_and_lower((tb.max() - tb) * (len(x) + 1) + place)
        return pdf.assign(_below=pdf["_below"] + _earlier_and_lower(x) - same)

    def corner(pdf: pd.DataFrame) -> pd.DataFrame:
        t, v = pdf["_tb"].to_numpy(), pdf["_vb"].to_numpy()
        grid = np.zeros((int(t.max()) + 2, int(v.max()) + 2), np.int64)  # TIME_BLOCKS by 2 * VALUE_CUTS + 1 at most
        grid[t + 1, v + 1] = pdf["_c"].to_numpy()
        return pdf.assign(_far=grid.cumsum(0).cumsum(1)[t, v])

    counted = pos.groupBy(*keys, "_tb").applyInPandas(near, _like(pos, "_below bigint"))
    whole = counted.where("_vb IS NULL")
    cut = counted.where("_vb IS NOT NULL")
    alone = cut.where("_vb % 2 = 1")  # one value only
    between = cut.where("_vb % 2 = 0")
    between = between.groupBy(*keys, "_vb").applyInPandas(beside, _like(cut))
    cells = pos.where("_vb IS NOT NULL").groupBy(*keys, "_tb", "_vb").agg(F.count("*").alias("_c"))
    cells = cells.groupBy(*keys).applyInPandas(corner, _like(cells, "_far bigint")).drop("_c")
    counts = alone.unionByName(between).join(cells, [*keys, "_tb", "_vb"]).select(*keys, "_t", (F.col("_below") + F.col("_far")).alias("_below"))
    counts = whole.select(*keys, "_t", "_below").unionByName(counts)
    pct = F.when(F.col("_t") >= min_obs, F.col("_below") / F.col("_t"))
    ranked = base.join(counts, [*keys, "_t"]).withColumn(out, pct).drop("_t", "_below")
    missing = df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return ranked.unionByName(missing)


def rolling_rank(
    df: DataFrame, s: Series, value: str, out: str, n: int, min_obs: int, block_rows: int = 65_536
) -> DataFrame:
    """Average-tie percentile rank of each value among the last n (itself included)."""
    blocks, bs = split(df, s, back=n - 1, block_rows=max(block_rows, n))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields
    ) + f", `{out}` double"

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        r = pdf[value].rolling(n, min_periods=min_obs).rank(pct=True)
        return pdf.assign(**{out: r.astype(float)})

    ranked = blocks.groupBy(*bs.part).applyInPandas(rank, schema)
    ranked = ranked.withColumn(out, F.when(~F.isnan(out), F.col(out)))
    return keep_own(ranked)
