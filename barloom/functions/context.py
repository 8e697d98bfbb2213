"""Sentiment and macro scores with their texts; sector names and regime flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as t
from .num import clamp, ratio, reasons, rnd
from .technical import bands


def normalise_sector(raw: Column) -> Column:
    pairs = [x for k, v in t.SECTOR_ALIASES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(raw))], F.lit("Unknown"))


def add_sentiment(df: DataFrame) -> DataFrame:
    """Needs news_count, news_score, change_pct, volume, avg_volume (all nullable)."""
    n, avg = F.coalesce("news_count", F.lit(0)), F.coalesce("news_score", F.lit(0.0))
    chg = F.coalesce("change_pct", F.lit(0.0))
    conviction = F.least(ratio("volume", F.greatest(F.col("avg_volume"), F.lit(1.0))), F.lit(3.0))
    df = df.withColumns(
        {
            "n_news": 50 + clamp(avg, -1, 1) * 40,
            "n_buzz": bands(n, t.BUZZ),
            "n_price_action": clamp(50 + chg * F.coalesce(conviction, F.lit(1.0)) * 4, 10, 90),
        }
    )
    comp = sum((F.col(f"n_{k}") * F.lit(w) for k, w in t.SENT_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("sent_score", rnd(comp, 2))


def sentiment_signals() -> Column:
    n, avg = F.coalesce("news_count", F.lit(0)), F.coalesce("news_score", F.lit(0.0))
    chg, head = F.coalesce("change_pct", F.lit(0.0)), F.coalesce("headline", F.lit(""))
    # fixed values: signal formats
    return reasons(
        (avg > 0.3, F.format_string("Positive news sentiment (+%.2f)", avg)),
        (avg < -0.3, F.format_string("Negative news sentiment (%.2f)", avg)),
        (n >= 5, F.format_string("High news volume (%d articles today)", n.cast("int"))),
        (chg > 2, F.format_string("Strong price action +%.1f%%", chg)),
        (chg < -2, F.format_string("Negative price action %.1f%%", chg)),
        (head != "", F.concat(F.lit("Top headline: "), F.substring(head, 1, 80))),
    )


def sector_momentum(ret: Column) -> Column:
    return F.coalesce(
        F.when(ret.isNotNull(), bands(ret, t.SECTOR_RETURN)), F.lit(t.UNKNOWN_SECTOR_MOMENTUM)
    )


def _flag_rules(flags: dict[str, bool]) -> list[tuple[Column, float, str]]:
    """(condition, points, reason) of every rule whose regime flag is set."""
    c = F.col
    pe = F.coalesce(F.when(c("pe_ratio") != 0, c("pe_ratio")), F.lit(20.0))
    beta = F.coalesce(F.when(c("beta") != 0, c("beta")), F.lit(1.0))
    div = F.coalesce("dividend_yield", F.lit(0.0))
    cap = F.coalesce(F.when(c("market_cap") != 0, c("market_cap")), F.lit(1e12))
    defensive = c("sector").isin("Healthcare", "Utilities", "Consumer")
    # fixed values: limits, points and texts of the macro rules
    rules = {
        "fed_hawkish": [
            (pe > 30, -8.0, "Fed hawkish: high-growth/high-PE stocks penalized"),
            (div > 0.03, 5.0, "Fed hawkish: dividend stocks resilient"),
        ],
        "recession_risk": [
            (defensive, 10.0, "Recession risk: defensive sector premium"),
            (
                ~defensive & (c("sector") == "Technology") & (beta > 1.3),
                -8.0,
                "Recession risk: high-beta tech penalized",
            ),
        ],
        "strong_dollar": [(cap > 200e9, -5.0, "Strong USD: multinational revenue headwind")],
        "earnings_season": [(F.lit(True), 3.0, "Earnings season: elevated opportunity")],
        "geopolitical_risk": [
            (
                c("sector").isin("Energy", "Industrials"),
                8.0,
                "Geopolitical risk: energy/defense tailwind",
            )
        ],
    }
    return [r for name in t.MACRO_FLAGS if flags.get(name) for r in rules[name]]


def add_macro(df: DataFrame, flags: dict[str, bool] | None = None) -> DataFrame:
    """Needs price, hi52, lo52, beta, market_cap, sector, sector_return, pe_ratio, dividend_yield."""
    c = F.col
    rules = _flag_rules(flags or {})
    hi = F.coalesce(F.when(c("hi52") != 0, c("hi52")), c("price"))
    lo = F.coalesce(F.when(c("lo52") != 0, c("lo52")), c("price"))
    cap_bn = F.when(c("market_cap") != 0, c("market_cap") / 1e9)
    df = df.withColumns(
        {
            "m_position": F.when((hi <= lo) | (hi <= 0), 50.0).otherwise(
                bands(ratio(c("price") - lo, hi - lo), t.POSITION_52W)
            ),
            "m_beta": F.when(c("beta").isNull(), 50.0).otherwise(bands(c("beta"), t.BETA)),
            "m_market_cap": F.when(cap_bn.isNull(), 50.0).otherwise(bands(cap_bn, t.MARKET_CAP_BN)),
            "m_sector": sector_momentum(c("sector_return")),
        }
    )
    comp = sum((c(f"m_{k}") * F.lit(w) for k, w in t.MACRO_WEIGHTS.items()), F.lit(0.0))
    for cond, pts, _ in rules:
        comp = comp + F.when(cond, F.lit(pts)).otherwise(F.lit(0.0))
    from_hi, from_lo = ratio(c("price") - hi, hi) * 100, ratio(c("price") - lo, lo) * 100
    # fixed values: signal formats
    texts = reasons(
        (from_hi > -5, F.format_string("Near 52-week high (%.1f%% below)", from_hi)),
        (from_lo < 20, F.format_string("Near 52-week low (%.1f%% above)", from_lo)),
        (c("beta") > 1.4, F.format_string("High-beta play (β=%.2f)", c("beta"))),
        ((c("beta") != 0) & (c("beta") < 0.6), F.format_string("Low-beta defensive (β=%.2f)", c("beta"))),
        *[(cond, text) for cond, _, text in rules],
    )
    return df.withColumns({"macro_score": rnd(clamp(comp, 0, 100), 2), "macro_signals": texts})
