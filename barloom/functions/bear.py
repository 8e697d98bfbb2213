"""Downtrend-continuation sub-scores, gates and signal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as t
from .num import clamp, ratio, reasons, rnd
from .technical import bands, macd_score, pair_share, toward

MIN_ROWS = 60


def add_scores(df: DataFrame) -> DataFrame:
    """Needs the indicator panel with roc60, bench_roc60, high20, dm14_*, down_share, row_no."""
    c, px = F.col, F.col("close")
    stack = [px, c("ema21"), c("ema50"), c("ema200")]
    trend = 20 + pair_share(stack, False) * 60 + F.when(c("ema50") < c("ema200"), 10.0).otherwise(0.0)
    off = ratio(c("high20") - px, "high20") * 100
    rej = 50 + F.least(F.lit(30.0), off * 2) + F.when(px < c("ema21"), 12.0).otherwise(0.0)
    df = df.withColumns(
        {
            "b_trend": F.least(F.lit(100.0), trend),
            "b_rel": F.coalesce(clamp(50 + (c("bench_roc60") - c("roc60")) * 2, 0, 100), F.lit(50.0)),
            "b_mom": clamp(50 + toward(-c("roc20"), 20, 1.2) + toward(-c("roc5"), 15, 1.5), 0, 100),
            "b_macd": macd_score(c("macd"), c("macd_hist"), c("prev_hist"), side=-1),
            "b_dist": F.coalesce(clamp(50 + (c("down_share") - 0.5) * 160, 0, 100), F.lit(50.0)),
            "down_trending": c("dm14_minus") > c("dm14_plus"),
            "b_rej": F.coalesce(clamp(rej, 0, 100), F.lit(50.0)),
        }
    )
    df = df.withColumn(
        "b_adx", F.when(~c("down_trending"), 35.0).otherwise(bands(c("adx"), t.BEAR_ADX))
    )
    comp = sum((c(f"b_{k}") * F.lit(w) for k, w in t.BEAR_WEIGHTS.items()), F.lit(0.0))
    return df.withColumns(
        {
            "bear_score": rnd(comp, 2),
            "dollar_volume": px * c("avg_volume"),
            "rel_strength": c("roc60") - c("bench_roc60"),
        }
    )


def gates():
    """Reasons that make a name untradeable on the short side."""
    c, px = F.col, F.col("close")
    # fixed values: reason formats
    return reasons(
        (
            c("rsi") < t.RSI_CAPITULATION,
            F.format_string("RSI %.0f — already capitulated, squeeze risk", c("rsi")),
        ),
        (
            c("dollar_volume") < t.MIN_BORROW_DOLLAR_VOLUME,
            F.format_string("thin: $%.0fM/day — borrow may be hard", c("dollar_volume") / 1e6),
        ),
        (px < c("bb_lower"), "below lower Bollinger — extended, poor entry"),
        (
            (c("ema50") > c("ema200")) & (px > c("ema50")),
            "still in an uptrend — this would be shorting strength",
        ),
        (
            c("rel_strength") > 0,
            F.format_string("outperforming the benchmark by %.1fpp over 60 bars", c("rel_strength")),
        ),
    )


def signals():
    c, px = F.col, F.col("close")
    # fixed values: signal formats
    return reasons(
        (
            (px < c("ema21")) & (c("ema21") < c("ema50")) & (c("ema50") < c("ema200")),
            "Full EMA bear alignment",
        ),
        (c("ema50") < c("ema200"), "Death-cross structure (EMA50 < EMA200)"),
        ((c("prev_hist") > 0) & (c("macd_hist") < 0), "MACD bearish crossover"),
        (c("roc20") < -5, F.format_string("20-day momentum %.1f%%", c("roc20"))),
        (
            c("rel_strength") < -5,
            F.format_string("Lagging the benchmark by %.1fpp over 60 bars", -c("rel_strength")),
        ),
        (c("b_dist") > 62, "Distribution: down days carry the volume"),
        ((c("adx") > 30) & c("down_trending"), F.format_string("Strong downtrend (ADX %.0f)", c("adx"))),
        (c("rsi") > 60, F.format_string("RSI %.0f — bounce into resistance", c("rsi"))),
        (px > c("ema200"), "Above EMA200 — counter-trend short"),
    )
