"""Tick streams: quotes, bars, source priority, live bias.

Every function takes a streaming or a batch DataFrame of ticks (symbol, ts, bid, ask); nothing here
keeps state outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.num import ratio, rnd
from ..sources.feeds import TICKS

LATE = "10 minutes"


def tick_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder as a tick stream."""
    reader = spark.readStream.schema(TICKS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def valid(ticks: DataFrame) -> DataFrame:
    ok = (F.col("bid") > 0) & (F.col("ask") > 0) & ~F.isnan("bid") & ~F.isnan("ask")
    return ticks.where(ok)


def quotes(ticks: DataFrame, typical: float = t.SPREAD_MEDIAN) -> DataFrame:
    """Mid, spread and spread relative to the typical one."""
    spread = F.col("ask") - F.col("bid")
    return valid(ticks).withColumns(
        {
            "price": (F.col("bid") + F.col("ask")) / 2,
            "spread": spread,
            "spread_x": rnd(spread / F.lit(typical), 2),
        }
    )


def bars(quoted: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Tumbling OHLC per symbol.  On a stream a window is emitted once the watermark has passed it
    and later ticks are dropped.  min_by/max_by combine map-side, so a hot symbol is one row per task."""
    return _ohlc(quoted.withWatermark("ts", late) if quoted.isStreaming else quoted, width)


def _ohlc(df: DataFrame, width: str) -> DataFrame:
    out = df.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", F.struct("ts", "price")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "price")).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def settled(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """One tick per symbol and time: of repeats and restatements the one with the highest `rev`, of equal ones the highest bid, then ask.

    ticks: symbol, ts, bid, ask, rev (null: before all others).  A restated tick that is no quote (`valid`) takes its time back.  On a
    stream a tick comes out when the watermark, `late` behind the newest tick, has passed it; corrections that come later are dropped.
    """
    df = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    # a struct of nulls and numbers orders nulls first, so a row without a revision yields to any other
    last = F.max(F.struct("rev", "bid", "ask")).alias("_t")
    return df.groupBy("symbol", "ts").agg(last).select("symbol", "ts", "_t.bid", "_t.ask", "_t.rev")


def corrected_bars(ticks: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Bars in which a tick counts once, as it was last stated: `settled` ticks chained to a second aggregate, on a stream in append mode.

    The state holds a row per tick of the last `late`, and one per open bar.
    """
    return _ohlc(quotes(settled(ticks, late)), width)


def best_source(feeds: DataFrame, asof: Column, stale: int = t.STREAM_STALE_SECONDS) -> DataFrame:
    """One price per symbol from feeds (symbol, ts, price, source, priority, market_open).

    The newest row of every source counts; the streamed source (priority 0) only while it is fresh,
    or at any age when the market is shut; the lowest priority number left wins.
    """
    newest = feeds.groupBy("symbol", "priority", "source").agg(
        F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"), F.max_by("market_open", "ts").alias("market_open")
    )
    age = F.unix_seconds(asof) - F.unix_seconds("ts")
    fit = newest.withColumn("age", age).where(
        (F.col("priority") > 0) | (F.col("age") <= stale) | ~F.col("market_open")
    )
    pick = F.min_by(F.struct("source", "price", "ts", "age"), F.col("priority"))
    return fit.groupBy("symbol").agg(pick.alias("_p")).select("symbol", "_p.*")


MIN_BARS = 210  # fixed value: bars needed before the averages count


def hours_in_force(hourly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Per symbol and clock hour the newest bar that was finished when the hour began, the last bar of each symbol).

    A bar holds from the end of its own hour to the end of the next bar's hour, over halts and weekends, so that an equality of
    hours finds it; the last one holds from then on.  `bars_seen` counts the bars up to it.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    hour = F.expr("INTERVAL 1 HOUR")
    held = hourly.withColumns({"bars_seen": F.row_number().over(w), "_until": F.lead("ts").over(w)})
    between = held.where("_until IS NOT NULL").withColumn("_hour", F.explode(F.sequence(F.col("ts") + hour, "_until", hour)))
    last = held.where("_until IS NULL").withColumn("_from", F.col("ts") + hour)
    return between, last


def with_bias(df: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Adds status, bias, dirn and risk to ticks with price, ema50, ema200, atr and bars_seen.

    `status` is ok, short history (fewer than `min_bars` bars) or no bars; only an ok row has a bias, a direction and a risk.
    """
    over = (F.col("price") > F.col("ema200")) & (F.col("price") > F.col("ema50"))
    under = (F.col("price") < F.col("ema200")) & (F.col("price") < F.col("ema50"))
    bias = F.when(over, "BULLISH").when(under, "BEARISH").otherwise("MIXED")
    dirn = F.when(over, 1).when(under, -1).when(F.col("price") > F.col("ema200"), 1).otherwise(-1)
    status = F.when(F.col("bars_seen").isNull(), "no bars").when(F.col("bars_seen") < min_bars, "short history").otherwise("ok")
    out = df.withColumn("status", status)
    fine = F.col("status") == "ok"
    return out.withColumns({"bias": F.when(fine, bias), "dirn": F.when(fine, dirn), "risk": F.when(fine, 1.5 * F.col("atr"))})


def hold_last(quoted: DataFrame, hourly: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Ticks with the averages of their symbol's last finished bar, however long ago that was, and the bias from them."""
    between, last = hours_in_force(hourly)
    cols = ("ema50", "ema200", "atr", "bars_seen")
    q = quoted.withColumn("_hour", F.date_trunc("hour", "ts"))
    h = between.select("symbol", "_hour", F.struct(*cols).alias("_h"))
    e = last.select("symbol", "_from", F.struct(*cols).alias("_e"))
    x = q.join(h, ["symbol", "_hour"], "left").join(e, "symbol", "left")  # one last row per symbol
    held = F.coalesce("_h", F.when(F.col("_hour") >= F.col("_from"), F.col("_e")))
    x = x.withColumn("_h", held)
    return with_bias(x.withColumns({c: F.col(f"_h.{c}") for c in cols}), min_bars).drop("_hour", "_h", "_e", "_from")


def live_bias(quoted: DataFrame, hourly: DataFrame, min_bars: int = MIN_BARS) -> DataFrame:
    """Bias of each tick against the averages of its symbol's last finished bar (stream-static join).

    hourly: symbol, ts, ema50, ema200, atr.  Every tick stays; see `with_bias` for the columns added.
    """
    return hold_last(quoted, hourly, min_bars).drop("bars_seen")


def parity_sample(quoted: DataFrame, seconds: int = 2) -> DataFrame:
    """Last tick per interval, for records that were polled and not streamed."""
    slot = F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000))
    rest = [c for c in quoted.columns if c != "symbol"]
    last = quoted.groupBy("symbol", slot.alias("_slot")).agg(F.max_by(F.struct(*rest), "ts").alias("_r"))
    return last.select("symbol", "_r.*")


def open_not_ranked(open_signals: DataFrame, ranked: DataFrame, key: str = "symbol") -> DataFrame:
    """Live signals whose name has dropped out of the ranking."""
    return open_signals.join(ranked.select(key), key, "left_anti")


def signal_view(events: DataFrame, price: Column, asof: Column) -> DataFrame:
    """Age, move, R multiple and distance to the fixed levels of issued signals."""
    c = F.col
    move = (price - c("entry")) * c("dirn")
    return events.withColumns(
        {
            "age_min": (F.unix_seconds(asof) - F.unix_seconds("issued_ts")) / 60.0,
            "move": move,
            "move_r": F.coalesce(rnd(ratio(move, "risk"), 2), F.lit(0.0)),
            "move_pct": F.coalesce(rnd(ratio(move, "entry") * 100, 2), F.lit(0.0)),
            "to_stop": F.abs(price - c("stop")),
            "to_tp1": F.abs(c("tp1") - price),
            "to_tp2": F.abs(c("tp2") - price),
        }
    )
