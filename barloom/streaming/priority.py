"""Which source names the price of a symbol, as a log of changes: the streamed one while it is fresh, else the next in line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from .ordered import Ordered
from .ticks import LATE

OUT = "symbol string, at long, source string, price double, row_at long, reason string"


class Sources(Ordered):
    """Emits a row whenever another source takes over; a timer at the end of the freshness of the streamed source sees its silence."""

    order = ("at", "priority", "price", "market_open")

    def __init__(self, sources: dict[str, int], stale: int) -> None:
        self.sources = sorted(sources, key=sources.get)
        self.streamed = [s for s in self.sources if sources[s] == 0]
        self.stale = stale * 1_000_000

    def advance(self, key, memory, rows, upto):
        rows = pd.DataFrame({"at": [], "source": [], "price": [], "market_open": []}) if rows is None else rows
        held = memory.setdefault("newest", {})  # source -> [time in microseconds, price, market open]
        stale, at, source = self.stale, rows["at"].to_numpy(np.int64), rows["source"].to_numpy(object)
        # the moments at which the choice can change: rows, and ends of freshness up to the watermark
        ends = [at[source == s] for s in self.streamed]
        ends += [np.array([held[s][0]], np.int64) for s in self.streamed if s in held]
        ends = np.concatenate([*ends, np.zeros(0, np.int64)]) + stale + 1000
        since = memory.get("seen", -(1 << 62))
        moments = np.unique(np.concatenate([at, ends[(ends <= upto) & (ends > since)]]))
        chosen = np.full(len(moments), -1)
        price, row_at = np.full(len(moments), np.nan), np.zeros(len(moments), np.int64)
        for i in reversed(range(len(self.sources))):
            s = self.sources[i]
            mine = source == s
            times, prices, shut = at[mine], rows["price"].to_numpy(float)[mine], ~rows["market_open"].to_numpy(bool)[mine]
            if s in held:
                times, prices, shut = np.append(held[s][0], times), np.append(held[s][1], prices), np.append(not held[s][2], shut)
            if not len(times):
                continue
            k = np.searchsorted(times, moments, side="right") - 1
            fits = k >= 0
            if s in self.streamed:
                fits &= (moments - times[np.maximum(k, 0)] <= stale) | shut.astype(bool)[np.maximum(k, 0)]
            chosen[fits], price[fits], row_at[fits] = i, prices[k[fits]], times[k[fits]]
            held[s] = [int(times[-1]), float(prices[-1]), not bool(shut[-1])]
        before = np.append(memory.get("chosen", -1), chosen[:-1]) if len(chosen) else chosen
        new = np.flatnonzero(chosen != before)
        if len(chosen):
            memory["chosen"] = int(chosen[-1])
        memory["seen"] = upto
        names = np.array([*self.sources, None], object)[chosen[new]]
        out = pd.DataFrame({"symbol": key[0], "at": moments[new], "source": names, "price": price[new]})
        out["row_at"] = pd.array(row_at[new], "Int64")
        out.loc[chosen[new] < 0, "row_at"] = pd.NA
        out["reason"] = np.where(np.isin(moments[new], at), "row", "silence")
        ends = [held[s][0] + stale + 1000 for s in self.streamed if s in held and held[s][2]]
        return out, min((e for e in ends if e > upto), default=None)


def source_changes(feeds: DataFrame, sources: dict[str, int], stale: int = t.STREAM_STALE_SECONDS, late: str = LATE, upto: Column | None = None) -> DataFrame:
    """symbol, ts, source, price, row_ts, reason: one row whenever another source begins to name the price of a symbol.

    feeds: symbol, ts, price, source, market_open; `sources` gives the priority of each (0 streams; the lowest that fits wins).  A
    streamed row fits for `stale` seconds, or at any age if it says that the market is shut.  `source` is null while none fits.
    `reason` is "row", or "silence" where a streamed source has gone quiet.  On a stream silence is judged by the
    watermark, that is by the rows of all symbols; of a history by `upto`, the newest row by default.
    """
    rows = feeds.where(F.col("source").isin(*sources))
    if feeds.isStreaming:
        rank = F.create_map(*[F.lit(x) for p in sources.items() for x in p])[F.col("source")]
        rows = rows.select("symbol", "ts", F.unix_micros("ts").alias("at"), "price", "source", "market_open", rank.alias("priority"))
        out = rows.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(
            statefulProcessor=Sources(sources, stale), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
        )
        return out.select("symbol", F.timestamp_micros("at").alias("ts"), "source", "price", F.timestamp_micros("row_at").alias("row_ts"), "reason")
    end = rows.agg(F.max("ts").alias("_end")) if upto is None else rows.sparkSession.range(1).select(upto.alias("_end"))
    held = F.struct(F.col("ts").alias("at"), F.col("price").alias("price"), F.col("market_open").alias("open"))
    of = {s: F.max(F.when(F.col("source") == s, held)).alias(f"_{i}") for i, s in enumerate(sources)}
    points = rows.groupBy("symbol", "ts").agg(*of.values())  # of rows of one source at one time the dearest counts
    live = [i for i, s in enumerate(sources) if sources[s] == 0]
    gone = F.col("ts") + F.expr(f"INTERVAL {stale}.001 SECONDS")
    quiet = points.where(" OR ".join(f"_{i} IS NOT NULL" for i in live)).select("symbol", gone.alias("ts")).join(F.broadcast(end), F.col("ts") <= F.col("_end")).drop("_end")
    marks = points.withColumn("_row", F.lit(True)).unionByName(quiet, allowMissingColumns=True)
    if upto is not None:
        marks = marks.where(F.col("ts") <= upto)
    marks = marks.groupBy("symbol", "ts").agg(F.max("_row").alias("_row"), *[F.max(f"_{i}").alias(f"_{i}") for i in range(len(sources))])
    w = Window.partitionBy("symbol").orderBy("ts")
    marks = marks.withColumns({f"_{i}": F.last(f"_{i}", True).over(w) for i in range(len(sources))})
    fits = []
    for s in sorted(sources, key=sources.get):
        i = list(sources).index(s)
        fit = F.col(f"_{i}").isNotNull()
        if sources[s] == 0:
            fit &= (F.col("ts") - F.expr(f"INTERVAL {stale} SECONDS") <= F.col(f"_{i}.at")) | ~F.col(f"_{i}.open")
        fits.append(F.when(fit, F.struct(F.lit(s).alias("source"), f"_{i}.price", F.col(f"_{i}.at").alias("row_ts"))))
    marks = marks.withColumn("_p", F.coalesce(*fits))
    name = F.coalesce(F.col("_p.source"), F.lit(""))
    before = F.coalesce(F.lag(name).over(w), F.lit(""))
    return marks.withColumn("_new", name != before).where("_new").select(
        "symbol", "ts", "_p.source", "_p.price", "_p.row_ts", F.when(F.col("_row"), "row").otherwise("silence").alias("reason")
    )
