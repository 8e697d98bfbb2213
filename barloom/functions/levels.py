"""Trade levels, votes, risk, grades and advice texts, long and short.

All inputs are indicators as reported (rounded), and every level is rounded where it is set.  The factors and limits in the
expressions below (1.5 ATR, 0.99, 1.003, RSI 68 and 32, ...) are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t
from .num import ratio, rnd


def grade(score: str) -> Column:
    out = None
    for bound, name in t.GRADES:
        hit = F.col(score) >= bound
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(t.LOWEST_GRADE)


def nearest_below(limit: Column, *levels: str) -> Column:
    """Highest level under the limit; NULL if none."""
    return F.greatest(*[F.when(F.col(x) < limit, F.col(x)) for x in levels])


def nearest_above(limit: Column, *levels: str) -> Column:
    return F.least(*[F.when(F.col(x) > limit, F.col(x)) for x in levels])


def add_long_levels(df: DataFrame) -> DataFrame:
    """entry zone, stop, targets and reward:risk; needs price, atr, rsi, ema*, bb_*, hi52 (nullable)."""
    c, px = F.col, F.col("price")
    df = df.withColumn("_atr", F.greatest(c("atr"), px * 0.005))
    pos = {f"_p_{x}": F.when(c(x) > 0, c(x)) for x in ("ema9", "ema21", "ema50", "bb_lower")}
    df = df.withColumns(pos).withColumn(
        "_near", F.coalesce(nearest_below(px * 0.99, *pos), px - 1.5 * c("_atr"))
    )
    hot, cold = c("rsi") > 68, c("rsi") < 32
    both = (c("ema21") < px) & (c("ema9") < px)
    raw = F.when(both, F.least("ema21", "ema9")).otherwise(c("_near"))
    floor = px * (1.0 - t.MAX_PULLBACK)
    df = df.withColumns({"deep_pullback": hot & (raw < floor), "_pull": F.greatest(raw, floor)})
    df = df.withColumns(
        {
            "entry": rnd(
                F.when(hot, c("_pull") * 1.003).when(cold, px * 1.002).otherwise((px + c("_near")) / 2), 2
            ),
            "zone_low": rnd(
                F.when(hot, c("_pull") * 0.995).when(cold, px * 0.993).otherwise(c("_near") * 0.997), 2
            ),
            "zone_high": rnd(F.when(hot, c("_pull") * 1.012).when(cold, px * 1.010).otherwise(px * 1.003), 2),
        }
    )
    e = c("entry")
    base = nearest_below(e * 0.995, "ema50", "ema200", "bb_lower")
    stop = F.coalesce(base - 0.4 * c("_atr"), e - 1.5 * c("_atr"))
    df = df.withColumn("stop", rnd(F.greatest(e * 0.91, F.least(e * 0.99, stop)), 2))
    df = df.withColumn("_risk", F.greatest(e - c("stop"), c("_atr") * 0.5))
    wall = nearest_above(e * 1.01, "bb_upper", "hi52")
    t1 = F.when(wall >= e + 0.8 * c("_risk"), wall).otherwise(e + 2.0 * c("_risk"))
    df = df.withColumn("_t1", rnd(t1, 2))
    floor_t1 = rnd(F.greatest(px + 1.2 * c("_risk"), px * 1.02), 2)
    df = df.withColumn("target_1", F.when(c("_t1") <= px, floor_t1).otherwise(c("_t1")))
    gain = c("target_1") - e
    return df.withColumns(
        {
            "target_2": rnd(e + F.greatest(1.75 * gain, 3.0 * c("_risk")), 2),
            "risk_reward": F.coalesce(rnd(ratio(gain, "_risk"), 2), F.lit(0.0)),
        }
    ).drop("_atr", *pos, "_near", "_pull", "_risk", "_t1")


def add_short_levels(df: DataFrame) -> DataFrame:
    """Mirror with its own limits: entry into a bounce, tighter stop, targets never below a cent."""
    c, px = F.col, F.col("price")
    df = df.withColumn("_atr", F.greatest(c("atr"), px * 0.005))
    first = nearest_above(px * 1.01, "ema21", "ema50", "bb_upper")
    washed, bounced = c("rsi") < 35, c("rsi") > 62
    anchor = F.coalesce(first, F.when(washed, px * 1.03).otherwise(px * 1.02))
    ceiling = px * (1.0 + t.MAX_BOUNCE)
    df = df.withColumns({"high_bounce": ~bounced & (anchor > ceiling), "_anchor": F.least(anchor, ceiling)})
    a = c("_anchor")
    df = df.withColumns(
        {
            "entry": rnd(F.when(washed, a * 0.997).when(bounced, px * 0.998).otherwise((px + a) / 2), 2),
            "zone_low": rnd(F.when(washed, a * 0.988).when(bounced, px * 0.990).otherwise(px * 0.997), 2),
            "zone_high": rnd(F.when(washed, a * 1.005).when(bounced, px * 1.007).otherwise(a * 1.003), 2),
        }
    )
    e = c("entry")
    wall = nearest_above(e * 1.005, "ema50", "ema200", "bb_upper")
    stop = F.coalesce(wall + 0.4 * c("_atr"), e + 1.5 * c("_atr"))
    df = df.withColumn(
        "stop", rnd(F.least(e * (1 + t.MAX_SHORT_STOP), F.greatest(e * 1.01, stop)), 2)
    )
    df = df.withColumn("_risk", F.greatest(c("stop") - e, c("_atr") * 0.5))
    pos = {f"_p_{x}": F.when(c(x) != 0, c(x)) for x in ("bb_lower", "ema200")}
    df = df.withColumns(pos)
    floor = nearest_below(e * 0.99, *pos)
    df = df.withColumn(
        "_t1", rnd(F.when(floor <= e - 0.8 * c("_risk"), floor).otherwise(e - 2.0 * c("_risk")), 2)
    )
    lower = rnd(F.least(px - 1.2 * c("_risk"), px * 0.98), 2)
    df = df.withColumn(
        "target_1", F.greatest(F.when(c("_t1") >= px, lower).otherwise(c("_t1")), F.lit(0.01))
    )
    gain = e - c("target_1")
    return df.withColumns(
        {
            "target_2": rnd(F.greatest(e - F.greatest(1.75 * gain, 3.0 * c("_risk")), F.lit(0.01)), 2),
            "risk_reward": F.coalesce(rnd(ratio(gain, "_risk"), 2), F.lit(0.0)),
        }
    ).drop("_atr", "_anchor", *pos, "_risk", "_t1")


def _points(*rules: tuple[Column, int]) -> Column:
    """Points of the first rule that holds, else 0."""
    out = None
    for cond, pts in rules:
        out = F.when(cond, pts) if out is None else out.when(cond, pts)
    return out.otherwise(0)


def add_status(df: DataFrame) -> DataFrame:
    """Five-step market status from votes for and against."""
    c, px, e50, e200 = F.col, F.col("price"), F.col("ema50"), F.col("ema200")
    up, down = (px > e50) & (e50 > e200), (px < e50) & (e50 < e200)
    total, rsi = c("total"), c("rsi")
    bull = (
        _points((up, 2), (down, 0), (px > e50, 1))
        + _points((rsi < 35, 2), (rsi < 50, 1))
        + _points((c("macd_hist") > 0, 1))
        + _points((total >= 68, 2), (total >= 58, 1))
    )
    bear = (
        _points((up, 0), (down, 2), (px > e50, 0), (px < e50, 1))
        + _points((rsi > 65, 1))
        + _points((c("macd_hist") > 0, 0), (F.lit(True), 1))
        + _points((total < 48, 2), (total < 55, 1))
    )
    df = df.withColumns({"_bull": bull, "_bear": bear})
    lead = F.when(c("_bull") > c("_bear"), 1).otherwise(-1)
    net = c("_bull") - c("_bear") + F.when(c("adx") > 30, lead).otherwise(0)
    status = (
        F.when(net >= 5, "Strong Bullish")
        .when(net >= 2, "Bullish")
        .when(net >= -1, "Neutral")
        .when(net >= -4, "Bearish")
        .otherwise("Strong Bearish")
    )
    return df.withColumn("status", status).drop("_bull", "_bear")


def risk_rating() -> Column:
    c = F.col
    pts = (
        _points((c("atr_pct") > 4, 3), (c("atr_pct") > 2.5, 2), (c("atr_pct") > 1.5, 1))
        + _points((c("beta") > 2, 2), (c("beta") > 1.4, 1))
        + _points((c("risk_reward") < 1.2, 2), (c("risk_reward") < 1.8, 1))
        + _points((c("total") < 48, 2), (c("total") < 55, 1))
        + _points((c("status").endswith("Bearish"), 2))
    )
    return F.when(pts >= 6, "High").when(pts >= 3, "Medium").otherwise("Low")


def squeeze_risk() -> Column:
    c = F.col
    stretch = ratio(c("ema21") - c("price"), "price") * 100
    pts = (
        _points((c("rsi") < 25, 3), (c("rsi") < 32, 2))
        + _points((stretch > 8, 3), (stretch > 4, 1))
        + _points((c("dollar_volume") == 0, 0), (c("dollar_volume") < 20e6, 3), (c("dollar_volume") < 75e6, 1))
        + _points((c("atr_pct") > 5, 2), (c("atr_pct") > 3, 1))
        + _points((c("beta") > 1.8, 1))
    )
    return F.when(pts >= 6, "High").when(pts >= 3, "Medium").otherwise("Low")


def setup_quality() -> Column:
    c = F.col
    return (
        F.when((c("bear_score") >= 70) & c("tradeable") & (c("squeeze") != "High"), "Textbook")
        .when((c("bear_score") >= 60) & c("tradeable"), "Partial")
        .otherwise("Weak")
    )


def long_advice() -> Column:
    """Own wording; the cases and the numbers in them are those of the scores above."""
    c, px, f = F.col, F.col("price"), F.format_string
    near = F.when(F.abs(px - c("ema21")) < F.abs(px - c("ema50")), c("ema21")).otherwise(c("ema50"))
    pct = lambda x: ratio(x, "entry") * 100
    lines = [
        f("%s: %s, total score %.1f of 100.", c("symbol"), F.lower("status"), c("total")),
        F.when(c("rsi") > 68, f("RSI %.1f is high: let price come back to the 21-bar average at %.2f.", c("rsi"), c("ema21")))
        .when(c("rsi") < 32, f("RSI %.1f is low: price sits at support and can be bought here.", c("rsi")))
        .otherwise(f("RSI %.1f is neutral: the nearest average is %.2f.", c("rsi"), near)),
        f("Entry %.2f, zone %.2f to %.2f.", c("entry"), c("zone_low"), c("zone_high")),
        F.when((px > c("ema50")) & (c("ema50") > c("ema200")), "Price leads both long averages.")
        .when((px < c("ema50")) & (c("ema50") < c("ema200")), "Price trails both long averages: bounces only.")
        .when(px > c("ema200"), "Price holds the 200-bar average."),
        F.when(c("adx") > 30, f("ADX %.0f: strong trend.", c("adx"))).when(c("adx") < 20, f("ADX %.0f: weak trend.", c("adx"))),
        F.when(c("deep_pullback"), f("Levels assume a fall to %.2f; price is %.1f%% above it now.", c("entry"), pct(px - c("entry")))),
        f("Stop %.2f (-%.1f%%).", c("stop"), pct(c("entry") - c("stop"))),
        f("Targets %.2f (+%.1f%%) and %.2f (+%.1f%%), reward:risk %.1f.", c("target_1"), pct(c("target_1") - c("entry")),
          c("target_2"), pct(c("target_2") - c("entry")), c("risk_reward")),
        F.when(c("risk") == "High", f("High risk (ATR %.1f%%): 1-2%% of capital.", c("atr_pct")))
        .when(c("risk") == "Medium", f("Medium risk (ATR %.1f%%): 2-4%% of capital.", c("atr_pct")))
        .otherwise(f("Low risk (ATR %.1f%%): 3-5%% of capital.", c("atr_pct"))),
    ]
    return F.concat_ws("\n\n", *lines)


def short_advice() -> Column:
    c, px, f = F.col, F.col("price"), F.format_string
    pct = lambda x: ratio(x, "entry") * 100
    stop_pct = pct(c("stop") - c("entry"))
    lines = [
        f("%s: bear score %.1f of 100, setup %s.", c("symbol"), c("bear_score"), F.lower("setup")),
        F.when((c("ema50") < c("ema200")) & (px < c("ema50")), "Price trails both long averages.")
        .when(px > c("ema200"), "Price is above the 200-bar average: a counter-trend short."),
        F.when(c("rel_strength") < 0, f("Lags the benchmark by %.1f points.", -c("rel_strength")))
        .when(c("rel_strength") >= 0, f("Beats the benchmark by %.1f points.", c("rel_strength"))),
        F.when(c("rsi") > 62, f("RSI %.1f: rally into resistance.", c("rsi")))
        .when(c("rsi") < 32, f("RSI %.1f: wait for a bounce to %.2f.", c("rsi"), c("entry"))),
        F.when(c("adx") > 30, f("ADX %.0f: strong trend.", c("adx"))).when(c("adx") < 20, f("ADX %.0f: weak trend.", c("adx"))),
        F.when(c("high_bounce"), f("Levels assume a bounce to %.2f.", c("entry"))),
        f("Entry %.2f, zone %.2f to %.2f, stop %.2f (+%.1f%%).", c("entry"), c("zone_low"), c("zone_high"), c("stop"), stop_pct),
        f("Targets %.2f (-%.1f%%) and %.2f (-%.1f%%), reward:risk %.1f.", c("target_1"), pct(c("entry") - c("target_1")),
          c("target_2"), pct(c("entry") - c("target_2")), c("risk_reward")),
        f("A gap of 2.5 times the stop costs %.0f%%.", stop_pct * 2.5),
        F.when(c("squeeze") == "High", "High squeeze risk: at most 0.5-1% of capital.")
        .when(c("squeeze") == "Medium", f("Medium squeeze risk (ATR %.1f%%): 1-2%% of capital.", c("atr_pct")))
        .otherwise(f("Low squeeze risk (ATR %.1f%%): 2-3%% of capital.", c("atr_pct"))),
        F.when(F.size("gate_reasons") > 0, F.concat(F.lit("Gates: "), F.array_join("gate_reasons", "; "), F.lit("."))),
    ]
    return F.concat_ws("\n\n", *lines)
