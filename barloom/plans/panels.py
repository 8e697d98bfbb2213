"""Indicator, technical and bearish panels: one pass over every bar of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bear, technical
from ..functions.num import ratio
from ..operators import rolling as W
from ..operators.asof import asof_fill
from ..operators.ema import add_ema, span_alpha
from ..operators.series import Series, plain, plainly, segmented
from ..operators.universe import complete


#: Exponential averages of the close that a panel carries from bar to bar, with the signal line of MACD.
AVERAGES = {"ema9": 9, "ema21": 21, "ema50": 50, "ema200": 200, "_fast": 12, "_slow": 26}
SIGNAL = {"_signal": 9}
#: Bars of a symbol that its newest row looks back on: the longest look back of a window (60 bars) and of windows over windows (30), with room.
TAIL = 100


def indicator_panel(
    bars: DataFrame, s: Series | None = None, carried: str | None = None, with_state: bool = False, tail: int | None = None
) -> DataFrame:
    """All simple and exponential inputs of the scores, plus `row_no` (1-based).

    `carried` names a struct of the averages (see AVERAGES, SIGNAL) as of the last bar before the new ones, null on new bars: averages then go
    on from there, and older bars serve the windows only.  `with_state` keeps the averages that are no output and adds `_left`, how many bars of its symbol
    come after a row.  `tail` adds it too and cuts each symbol to its last bars as soon as the averages, which need all of them, are known: windows of the newest row
    reach back less than TAIL bars.

    Bars with a missing price are dropped first: the windows count rows.  Written level by level, so that everything that can share a window operator does: exponential
    averages, row-to-row moves, rolling aggregates of the moves, rolling means of those, lags.
    """
    b, s = segmented(complete(bars), s or plain())
    c, back = F.col, lambda x, k: F.lag(x, k).over(s.ordered())
    if carried is None:
        b = add_ema(b, s, {out: ("close", span_alpha(n)) for out, n in AVERAGES.items()})
        b = b.withColumn("macd", c("_fast") - c("_slow"))
        b = add_ema(b, s, {out: ("macd", span_alpha(n)) for out, n in SIGNAL.items()})
    else:
        # the last old bar enters with the average itself, older ones not at all, and an average starts at its first value
        old = lambda out, x: F.when(c("_old"), c(f"{carried}.{out}")).otherwise(c(x))
        going = lambda spans: {out: (f"_x{out}", span_alpha(n)) for out, n in spans.items()}
        b = b.withColumns({f"_x{out}": old(out, "close") for out in AVERAGES})
        b = add_ema(b, s, going(AVERAGES), late=tuple(f"_x{out}" for out in AVERAGES))
        b = b.withColumn("macd", c("_fast") - c("_slow")).withColumns({f"_x{out}": old(out, "macd") for out in SIGNAL})
        b = add_ema(b, s, going(SIGNAL), late=tuple(f"_x{out}" for out in SIGNAL))
        b = b.drop(*[f"_x{out}" for out in (*AVERAGES, *SIGNAL)])
    b = b.withColumn("row_no", c(s.index) + 1)
    if with_state or tail is not None:
        b = b.withColumn("_left", F.max("row_no").over(Window.partitionBy(*s.keys)) - c("row_no"))
    if tail is not None:
        b = b.where(c("_left") < tail)
    b = b.withColumns(
        {
            "_d": W.change("close", 1, s),
            "tr": W.true_range(s),
            "dm_plus": W.directional(s)[0],
            "dm_minus": W.directional(s)[1],
            "ret": W.roc("close", 1, s),
            **{f"roc{k}": W.roc("close", k, s) * 100 for k in (5, 20, 60)},
        }
    )
    up, down = F.greatest(c("_d"), F.lit(0.0)), F.greatest(-c("_d"), F.lit(0.0))
    b = b.withColumns(
        {
            "_gain": F.when(c("_d").isNotNull(), up),
            "_loss": F.when(c("_d").isNotNull(), down),
            "_dvol": F.when(c("ret") < 0, c("volume")),
            "_uvol": F.when(c("ret") > 0, c("volume")),
        }
    )
    b = b.withColumns(
        {
            "rsi": W.rsi_of(W.sma("_gain", 14, s, 1), W.sma("_loss", 14, s, 1)),
            "atr": W.sma("tr", 14, s, 0),
            "_dmp": W.sma("dm_plus", 14, s, 0),
            "_dmm": W.sma("dm_minus", 14, s, 0),
            "_lo14": W.rmin("low", 14, s, 0),
            "_hi14": W.rmax("high", 14, s, 0),
            "bb_mid": W.sma("close", 20, s, 0),
            "_sd20": W.rstd("close", 20, s, 0),
            "avg_volume": W.sma("volume", 20, s, 0),
            "high20": W.rmax("high", 20, s, 0),
            "_dv": F.sum("_dvol").over(s.last(20)),
            "_uv": F.sum("_uvol").over(s.last(20)),
        }
    )
    dip, dim = 100 * ratio("_dmp", "atr"), 100 * ratio("_dmm", "atr")
    sold, bought = F.coalesce("_dv", F.lit(0.0)), F.coalesce("_uv", F.lit(0.0))
    b = b.withColumns(
        {
            "bb_upper": c("bb_mid") + 2.0 * c("_sd20"),
            "bb_lower": c("bb_mid") - 2.0 * c("_sd20"),
            "stoch_k": 100 * (c("close") - c("_lo14")) / (c("_hi14") - c("_lo14") + F.lit(1e-9)),
            "_dx": 100 * F.abs(dip - dim) / (dip + dim + F.lit(1e-9)),
            "dm14_plus": c("_dmp") * 14,
            "dm14_minus": c("_dmm") * 14,
            "down_share": F.when(c("row_no") >= 25, ratio(sold, sold + bought)),
        }
    )
    b = b.withColumns({"stoch_d": W.sma("stoch_k", 3, s), "adx": W.sma("_dx", 14, s)})
    b = b.drop("_d", "_gain", "_loss", "_dvol", "_uvol", "_dmp", "_dmm", "_lo14", "_hi14", "_sd20", "_dv", "_uv", "_dx")
    b = b.withColumn("macd_hist", c("macd") - c("_signal"))
    b = b.withColumns(
        {
            "prev_hist": back("macd_hist", 1),
            "prev_ema50": back("ema50", 1),
            "prev_ema200": back("ema200", 1),
        }
    )
    inner = () if with_state else ("_fast", "_slow", "_signal")
    return plainly(b.drop(*inner, "tr", "dm_plus", "dm_minus"))


def technical_panel(bars: DataFrame, s: Series | None = None, min_rows: int = technical.MIN_ROWS) -> DataFrame:
    """Scores for every bar with enough history; past rows never change when bars are appended."""
    p = indicator_panel(bars, s).where(F.col("row_no") >= min_rows)
    return technical.add_scores(technical.with_defaults(p))


def bear_panel(bars: DataFrame, bench: str, s: Series | None = None, min_rows: int = bear.MIN_ROWS) -> DataFrame:
    s = s or plain()
    # the series of one symbol is bounded by the calendar
    b = asof_fill(bars, s, F.broadcast(bars.where(F.col("symbol") == bench)), "close", out="bench_close")
    b = b.withColumn("bench_roc60", W.roc("bench_close", 60, s) * 100)
    p = technical.with_defaults(indicator_panel(b, s)).where(F.col("row_no") >= min_rows)
    return bear.add_scores(p)


def newest_rows(bars: DataFrame, s: Series | None = None) -> DataFrame:
    """The newest row of every symbol in the indicator panel: averages run over all its bars, rolling windows over the last TAIL.

    The row is told by its number within the layout of the windows, so wide rows are not sorted again.
    """
    return indicator_panel(bars, s, tail=TAIL).where(F.col("_left") == 0).drop("_left")


def newest_scores(bars: DataFrame, s: Series | None = None, min_rows: int = technical.MIN_ROWS) -> DataFrame:
    """Scores of the newest bar of every symbol; fewer than `min_rows` bars give the neutral score and `short_history`.

    The newest rows are cut out before the scores, which are computed once per symbol.
    """
    p = newest_rows(bars, s)
    short = F.col("row_no") < min_rows
    p = technical.add_scores(technical.with_defaults(p, short))
    return p.withColumns({"short_history": short, "tech_score": F.when(short, 50.0).otherwise(F.col("tech_score"))})


def newest_bear_scores(bars: DataFrame, bench: str, s: Series | None = None, min_rows: int = bear.MIN_ROWS) -> DataFrame:
    """The bearish side of `newest_scores`."""
    s = s or plain()
    # the series of one symbol is bounded by the calendar
    b = asof_fill(bars, s, F.broadcast(bars.where(F.col("symbol") == bench)), "close", out="bench_close")
    b = b.withColumn("bench_roc60", W.roc("bench_close", 60, s) * 100)
    p = newest_rows(b, s)
    short = F.col("row_no") < min_rows
    p = bear.add_scores(technical.with_defaults(p, short))
    return p.withColumns({"short_history": short, "bear_score": F.when(short, 50.0).otherwise(F.col("bear_score"))})


def year_range(bars: DataFrame, days: int = 364) -> DataFrame:
    """High and low of the bars of the 52 weeks up to the last bar of each symbol, whatever the width of a bar."""
    last = F.max("ts").over(Window.partitionBy("symbol"))
    year = bars.withColumn("_last", last).where(F.col("ts") > F.col("_last") - F.expr(f"INTERVAL {days} DAYS"))
    return year.groupBy("symbol").agg(F.max("high").alias("hi52"), F.min("low").alias("lo52"))
