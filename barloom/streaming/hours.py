"""Bias of ticks from averages that the stream makes itself: hour bars, EMA50, EMA200 and ATR live in the state of a symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rolling as W
from ..operators.ema import add_ema, span_alpha, wilder_alpha
from ..operators.series import plain
from .ordered import Ordered
from .ticks import LATE, MIN_BARS, bars, hold_last, quotes, with_bias

#: (name, weight of a new bar) of the averages, of the close and of the true range.
CLOSE = {"ema50": span_alpha(50), "ema200": span_alpha(200)}
RANGE = {"atr": wilder_alpha(24)}

HOUR = 3_600_000_000  # microseconds
OUT = "symbol string, at long, price double, ema50 double, ema200 double, atr double, bars_seen long"


class Hours(Ordered):
    """Gives every tick the averages as of the last bar that was finished when its hour began.

    A bar is closed by the first tick of a later hour; as ticks come in order and are final, no bar changes afterwards.  Python
    looks at hours, arrays hold the ticks of one.
    """

    order = ("at", "price")

    def advance(self, key, memory, rows, upto):
        if rows is None or rows.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")]), None
        hour = rows["at"].to_numpy(np.int64) // HOUR
        price = rows["price"].to_numpy(float)
        first = np.flatnonzero(np.concatenate([[True], hour[1:] != hour[:-1]]))
        out = np.full((len(first), 4), np.nan)
        for i, (a, b) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(hour)])):
            if memory.get("hour") not in (None, int(hour[a])):
                self._finish(memory)
            if memory.get("bars"):
                out[i] = *(memory[n] for n in (*CLOSE, *RANGE)), memory["bars"]
            part = price[a:b]
            if memory.get("hour") == int(hour[a]):
                memory |= {"high": max(memory["high"], float(part.max())), "low": min(memory["low"], float(part.min())), "close": float(part[-1])}
            else:
                memory |= {"hour": int(hour[a]), "high": float(part.max()), "low": float(part.min()), "close": float(part[-1])}
        size = np.diff(np.append(first, len(hour)))
        cols = np.repeat(out, size, axis=0)
        found = pd.DataFrame({"symbol": key[0], "at": rows["at"], "price": price, "ema50": cols[:, 0], "ema200": cols[:, 1], "atr": cols[:, 2]})
        found["bars_seen"] = pd.array(np.where(np.isnan(cols[:, 3]), 0, cols[:, 3]).astype(np.int64), "Int64")
        return found, None

    @staticmethod
    def _finish(memory: dict) -> None:
        """Take the bar in hand into the averages: y += weight * (x - y), from the first value on."""
        high, low, close, before = memory["high"], memory["low"], memory["close"], memory.get("before")
        span = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        for value, names in ((close, CLOSE), (span, RANGE)):
            for name, weight in names.items():
                memory[name] = value if name not in memory else (1.0 - weight) * memory[name] + weight * value
        memory |= {"before": close, "bars": memory.get("bars", 0) + 1}


def hour_state(ticks: DataFrame) -> DataFrame:
    """The averages after every hour bar of the ticks (batch): symbol, ts, ema50, ema200, atr."""
    s = plain()
    b = bars(quotes(ticks)).withColumn("_tr", W.true_range(s))
    specs = {n: ("close", w) for n, w in CLOSE.items()} | {n: ("_tr", w) for n, w in RANGE.items()}
    return add_ema(b, s, specs).select("symbol", "ts", *specs)


def self_biased(ticks: DataFrame, late: str = LATE, min_bars: int = MIN_BARS) -> DataFrame:
    """symbol, ts, price, ema50, ema200, atr, status, bias, dirn, risk of every tick, from the ticks alone.

    On a stream a tick comes out when the watermark, `late` behind the newest tick, has passed it: a larger `late` takes in more
    stragglers, a smaller one answers sooner.  A replay of the history gives the same rows.
    """
    quoted = quotes(ticks)
    if not ticks.isStreaming:
        return hold_last(quoted, hour_state(ticks), min_bars).select("symbol", "ts", "price", "ema50", "ema200", "atr", "status", "bias", "dirn", "risk")
    rows = quoted.select("symbol", "ts", F.unix_micros("ts").alias("at"), "price").withWatermark("ts", late)
    out = rows.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Hours(), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
    known = F.col("bars_seen") > 0
    out = out.withColumns({c: F.when(known, F.col(c)) for c in ("ema50", "ema200", "atr", "bars_seen")})
    return with_bias(out.withColumn("ts", F.timestamp_micros("at")), min_bars).drop("at", "bars_seen")
