"""First-touch exits over long horizons.

`events.first_touch` carries the next n bars in every row, which is right for some tens of bars.  Here rows stay as narrow as
they are: a block of a series, with the horizon's rows of the block after it, gets a pyramid of minima of its lows and of its
negated highs, and every trade climbs and descends it to the first bar at or past its level.  The memory of a task is that of
its block, whatever the horizon, and one trade costs a logarithm of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import series
from .series import Series

EXIT = T.StructType([T.StructField("r", T.DoubleType()), T.StructField("bars", T.IntegerType())])


def pyramid(values: np.ndarray) -> list[np.ndarray]:
    """Levels of minima over 1, 2, 4, ... values; missing values count as endless."""
    level = np.full(1 << max(0, int(len(values) - 1).bit_length()), np.inf)
    level[: len(values)] = np.where(np.isnan(values), np.inf, values)
    out = [level]
    while len(out[-1]) > 1:
        out.append(np.minimum(out[-1][0::2], out[-1][1::2]))
    return out


def first_at_most(levels: list[np.ndarray], start: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each start the first place from it on whose value is `bound` or less; the width of the pyramid where there is none."""
    width = len(levels[0])
    at = start.astype(np.int64).copy()
    found = np.full(len(at), -1)
    for h, level in enumerate(levels):
        # a node that is a right child is not covered by its parent's other half: look at it before climbing
        odd = (found < 0) & (at < len(level)) & ((at & 1 == 1) | (len(level) == 1))
        some = np.flatnonzero(odd)
        hit = level[at[some]] <= bound[some]
        found[some[hit]] = h
        at[some[~hit]] += 1
        open_ = found < 0
        at[open_] >>= 1
    for h in range(len(levels) - 2, -1, -1):
        down = np.flatnonzero(found > h)
        left = 2 * at[down]
        at[down] = np.where(levels[h][left] <= bound[down], left, left + 1)
    return np.where(found < 0, width, at)


def touched(high: np.ndarray, low: np.ndarray, close: np.ndarray, at: np.ndarray, dirn: np.ndarray, entry: np.ndarray, risk: np.ndarray, rr: np.ndarray, horizon: int):
    """(result in R, bars held) of trades entered at row `at`; NaN and 0 where there is no bar ahead or no risk."""
    lows, highs = pyramid(low), pyramid(-high)
    stop, target = entry - dirn * risk, entry + dirn * risk * rr
    up = dirn > 0
    last = np.minimum(at + horizon, len(close) - 1)
    hit_stop, hit_target = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for side, down, over in ((up, (lows, stop), (highs, -target)), (~up, (highs, -stop), (lows, target))):
        for out, (levels, bound) in ((hit_stop, down), (hit_target, over)):
            out[side] = first_at_most(levels, at[side] + 1, bound[side])
    with np.errstate(divide="ignore", invalid="ignore"):
        timed_out = dirn * (close[last] - entry) / risk
    first = np.minimum(hit_stop, hit_target)
    r = np.where(first > last, timed_out, np.where(hit_stop <= hit_target, -1.0, rr))
    ok = (last > at) & (risk > 0)
    return np.where(ok, r, np.nan), np.where(ok, np.minimum(first, last) - at, 0).astype(np.int32)


def first_touch_exits(df: DataFrame, s: Series, trades: Column, horizon: int, out: str = "exits", block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Adds `out`: one (r, bars) per trade of the row, in the order of `trades`.

    trades: array of (dirn, entry, risk, rr); a null or empty one enters nothing.  Every bar after the entry, up to `horizon` of
    them, is looked at; the stop wins a bar that touches both levels; without a touch the trade is marked to the last of these bars.
    r and bars are null without a bar ahead or a positive risk, for null entries and levels, and r where the last close is null;
    a bar without a high or low touches nothing on that side.
    """
    wide = df.withColumn("_trades", F.transform(trades, lambda t: F.struct(*[t[c].cast("double").alias(c) for c in ("dirn", "entry", "risk", "rr")])))
    cut, blocked = series.split(wide, s, 0, horizon, block_rows=max(block_rows, horizon))
    cut = cut.drop(*[f"_s{n}" for n in series.SEGMENTS])
    names = [*df.columns, out]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(EXIT))])

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("_pos").combine_chunks()
        high, low, close = (block.column(c).cast(pa.float64()).to_numpy() for c in ("high", "low", "close"))
        own = np.flatnonzero(block.column("_own").to_numpy())
        lists = pa.concat_arrays(block.column("_trades").take(pa.array(own)).chunks)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        dirn, entry, risk, rr = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in flat.flatten())
        known = ~np.isnan(dirn + entry + risk + rr)
        r, bars = touched(high, low, close, np.repeat(own, sizes), dirn, entry, np.where(known, risk, 0.0), rr, horizon)
        held = pa.array(bars, mask=bars == 0)
        ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))
        exits = pa.StructArray.from_arrays([pa.array(r, mask=np.isnan(r)), held], ["r", "bars"])
        kept = block.select(names[:-1]).take(pa.array(own))
        return kept.append_column(out, pa.ListArray.from_arrays(ends, exits)).select(names)

    return cut.groupBy(*blocked.part).applyInArrow(run, schema)
