"""From ticks to signals as one query, on a stream or over a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as t
from ..operators.sessions import add_clock, market_status
from .latch import latch_batch, latch_stream
from .hours import self_biased
from .ticks import LATE, live_bias, quotes


def latch_rows(ticks: DataFrame, hourly: DataFrame | None, late: str = LATE) -> DataFrame:
    """Latch input: quotes, the bias from the last finished bar, and whether the market is open."""
    biased = self_biased(ticks, late) if hourly is None else live_bias(quotes(ticks), hourly)
    x = market_status(add_clock(biased))
    return x.select(F.col("symbol").alias("key"), "ts", "bias", "dirn", "price", "risk", "atr", "market_open")


def live_signals(ticks: DataFrame, hourly: DataFrame | None = None, cooldown_min: float = t.STOP_COOLDOWN_MIN, late: str = LATE) -> DataFrame:
    """Events of the latched signals.  ticks: symbol, ts, bid, ask, streaming or not.

    Without `hourly` the averages are made from the ticks themselves, on a stream by a stateful operator in front of the latch, whose
    state lasts over restarts; events then come out `late` behind the newest tick.  Else hourly gives symbol, ts, ema50, ema200,
    atr of finished bars and is read once.
    """
    rows = latch_rows(ticks, hourly, late)
    return latch_stream(rows, cooldown_min) if ticks.isStreaming else latch_batch(rows, cooldown_min)
