"""Long-side technical sub-scores, composite, time-frame flags and signal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t
from .num import banded, clamp, ratio, reasons, rnd

MIN_ROWS = 30


def bands(c: Column, table) -> Column:
    op, steps, other = table
    return banded(c, op, steps, other)


def pair_share(vals: list[Column], above: bool) -> Column:
    """Share of neighbouring pairs that fall (above) or rise along the list."""
    n = len(vals) - 1
    hits = sum(
        (F.when(a > b if above else a < b, 1).otherwise(0) for a, b in zip(vals, vals[1:])), F.lit(0)
    )
    return hits / F.lit(n)


def cross_points(prev: Column, now: Column, up: float) -> Column:
    """`up` when the histogram crosses zero upwards, -`up` downwards, else 0."""
    return F.when((prev < 0) & (now > 0), up).when((prev > 0) & (now < 0), -up).otherwise(0.0)


def macd_score(macd: Column, now: Column, prev: Column, side: int = 1) -> Column:
    """side 1 rewards a rising histogram above zero, -1 is its mirror."""
    better = now > prev if side > 0 else now < prev
    beyond = macd > 0 if side > 0 else macd < 0
    pts = (
        F.lit(50.0)
        + cross_points(prev, now, 30.0 * side)
        + F.when(better, 15.0).otherwise(-10.0)
        + F.when(beyond, 10.0).otherwise(-10.0)
    )
    return clamp(pts, 0, 100)


def toward(x: Column, cap: float, per: float) -> Column:
    """+min(cap, per*|x|) for a rise, minus the same for a fall or no move."""
    size = F.least(F.lit(float(cap)), F.abs(x) * F.lit(float(per)))
    return F.when(x > 0, size).otherwise(-size)


def with_defaults(df: DataFrame, short: Column | None = None) -> DataFrame:
    """The neutral value of every indicator that has no full window yet, or wherever `short` holds."""
    px = F.col("close")
    neutral = {
        "rsi": F.lit(50.0), "macd": F.lit(0.0), "macd_hist": F.lit(0.0), "prev_hist": F.lit(0.0),
        "bb_upper": px, "bb_lower": px, "ema9": px, "ema21": px, "ema50": px, "ema200": px,
        "atr": F.lit(0.0), "stoch_k": F.lit(50.0), "stoch_d": F.lit(50.0), "adx": F.lit(20.0),
        "avg_volume": F.col("volume"), "roc5": F.lit(0.0), "roc20": F.lit(0.0),
    }
    known = (lambda c: F.col(c)) if short is None else (lambda c: F.when(~short, F.col(c)))
    return df.withColumns({c: F.coalesce(known(c), v) for c, v in neutral.items()})


def add_scores(df: DataFrame) -> DataFrame:
    c = F.col
    px, width = c("close"), c("bb_upper") - c("bb_lower")
    emas = [px, c("ema9"), c("ema21"), c("ema50"), c("ema200")]
    ema_pts = 20 + pair_share(emas, True) * 60 + F.when(c("ema50") > c("ema200"), 10.0).otherwise(0.0)
    k, dline = c("stoch_k"), c("stoch_d")
    stoch = (
        F.when((k < 20) & (k > dline), 80.0)
        .when(k < 20, 65.0)
        .when((k > 80) & (k < dline), 20.0)
        .when(k > 80, 30.0)
        .otherwise(40 + (50 - k) * 0.2)
    )
    subs = {
        "s_rsi": bands(c("rsi"), t.RSI),
        "s_macd": macd_score(c("macd"), c("macd_hist"), c("prev_hist")),
        "s_bb": F.when(width < 1e-9, 50.0).otherwise(
            bands(F.try_divide(px - c("bb_lower"), width), t.BOLLINGER)
        ),
        "s_ema": F.least(F.lit(100.0), ema_pts),
        "s_vol": F.when(c("avg_volume") <= 0, 50.0).otherwise(
            bands(F.try_divide("volume", "avg_volume"), t.VOLUME)
        ),
        "s_mom": clamp(50 + toward(c("roc5"), 15, 2) + toward(c("roc20"), 10, 1), 0, 100),
        "s_stoch": clamp(stoch, 0, 100),
        "s_adx": bands(c("adx"), t.ADX),
    }
    df = df.withColumns(subs)
    comp = sum((c(f"s_{k}") * F.lit(w) for k, w in t.TECH_WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("composite", comp)
    comp, vol, avg = c("composite"), c("volume"), c("avg_volume")
    atr_pct = F.coalesce(ratio("atr", "close") * 100, F.lit(0.0))
    return df.withColumns(
        {
            "tech_score": rnd(comp, 2),
            "atr_pct": atr_pct,
            "scalp": ((c("rsi") < 35) | (c("rsi") > 70)) & (vol > avg * 1.5) & (atr_pct > 0.5),
            "day": (comp > 62) & (c("adx") > 20) & (vol > avg * 1.2),
            "swing": (comp > 60) & (c("ema50") > c("ema200")) & (c("roc20") > 0),
            "invest": (comp > 58) & (c("ema200") > 0) & (px > c("ema200")) & (c("adx") > 20),
        }
    )


def timeframes() -> Column:
    tags = reasons(*[(F.col(x), x.upper()) for x in ("scalp", "day", "swing", "invest")])
    return F.when(F.size(tags) == 0, F.array(F.lit("WATCH"))).otherwise(tags)


def signals() -> Column:
    """Texts in a fixed order; needs prev_ema50 and prev_ema200 next to the scores."""
    c, px = F.col, F.col("close")
    one = lambda f, x: F.format_string(f, x)
    prev, now = c("prev_hist"), c("macd_hist")
    # fixed values: signal formats
    return reasons(
        (c("rsi") < 35, one("RSI oversold (%.1f)", c("rsi"))),
        (c("rsi") > 65, one("RSI overbought (%.1f)", c("rsi"))),
        ((prev < 0) & (now > 0), "MACD bullish crossover"),
        ((prev > 0) & (now < 0), "MACD bearish crossover"),
        (px < c("bb_lower"), "Price below lower Bollinger Band"),
        (px > c("bb_upper"), "Price above upper Bollinger Band"),
        (
            (c("ema50") > c("ema200")) & (c("prev_ema50") <= c("prev_ema200")),
            "Golden Cross (EMA50 crossed above EMA200)",
        ),
        (
            (px > c("ema9")) & (c("ema9") > c("ema21")) & (c("ema21") > c("ema50")),
            "Full EMA bull alignment",
        ),
        (
            c("volume") > c("avg_volume") * 2,
            one("Volume surge (%.1fx avg)", F.try_divide("volume", "avg_volume")),
        ),
        (c("adx") > 30, one("Strong trend (ADX %.0f)", c("adx"))),
        (c("stoch_k") < 20, one("Stochastic oversold (%.0f)", c("stoch_k"))),
        (c("roc5") > 3, one("5-day momentum +%.1f%%", c("roc5"))),
    )


def as_reported(df: DataFrame) -> DataFrame:
    """Indicators at the precision that levels, votes and reports work with."""
    places = {
        "rsi": 1, "macd": 4, "macd_hist": 4, "bb_upper": 2, "bb_lower": 2, "ema9": 2, "ema21": 2, "ema50": 2,
        "ema200": 2, "atr": 2, "atr_pct": 2, "stoch_k": 1, "adx": 1, "roc5": 2, "roc20": 2,
    }
    out = {c: rnd(c, p) for c, p in places.items()}
    vr = F.when(F.col("avg_volume") != 0, F.try_divide("volume", "avg_volume")).otherwise(1.0)
    out["vol_ratio"] = rnd(vr, 2)
    return df.withColumns(out)
