"""End-to-end screens: bars, statements, news and dimensions in, one ranked row per symbol out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bear, context, fundamental, levels, technical
from ..functions import tables as t
from ..functions.num import money, printed, ratio, rnd, signed
from ..operators.cross import sector_capped_top
from ..operators.settle import settle
from ..operators.universe import latest_quotes
from .panels import newest_bear_scores, newest_scores, year_range


def sector_returns(quotes: DataFrame, proxies: dict[str, str]) -> DataFrame:
    """One-bar return of each sector's proxy; `proxies` is a fixed table of a dozen rows."""
    pairs = F.create_map(*[x for s, p in proxies.items() for x in (F.lit(p), F.lit(s))])
    return quotes.where(F.col("symbol").isin(*proxies.values())).select(
        pairs[F.col("symbol")].alias("sector"), F.col("symbol").alias("proxy"), F.col("change_pct").alias("sector_return")
    )


def fundamentals(statements: DataFrame, facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Company record with ratios and scores.  prices: symbol, price."""
    f = (
        facts.join(prices, "symbol")
        .join(fundamental.latest_items(statements), "symbol", "left")
        .withColumns(
            {
                "sector": context.normalise_sector(F.col("raw_sector")),
                "target_price": F.col("price") * F.col("target_mult"),
            }
        )
    )
    return fundamental.add_scores(fundamental.add_ratios(f))


def with_quote(newest: DataFrame, quotes: DataFrame) -> DataFrame:
    """Price and change of the newest rows; a symbol with a single bar has its close and no change."""
    q = quotes.select("symbol", "price", "change_pct")
    return newest.join(q, "symbol", "left").withColumns(
        {"price": F.coalesce("price", "close"), "change_pct": F.coalesce("change_pct", F.lit(0.0))}
    )


def long_scores(
    bars: DataFrame, statements: DataFrame, facts: DataFrame, news: DataFrame, proxies: dict[str, str],
    flags: dict[str, bool] | None = None,
) -> DataFrame:
    """Every symbol's composite score, levels, status, risk and texts.

    `news`: symbol, news_count, news_score, headline.  Left joins with neutral defaults, so a symbol
    without statements or news keeps its technical score.  Bars are read by four steps, so they are
    settled first.
    """
    bars = settle(bars)
    tech = newest_scores(bars)
    # fixed value: the text of a name without enough bars
    texts = F.when(F.col("short_history"), F.array(F.lit("Insufficient data"))).otherwise(technical.signals())
    tech = technical.as_reported(tech.withColumn("tech_signals", texts))
    quotes = latest_quotes(bars)
    fund = fundamentals(statements, facts, quotes.select("symbol", "price"))
    df = (
        with_quote(tech, quotes)
        .join(fund.drop("price"), "symbol", "left")
        .join(year_range(bars), "symbol", "left")
        .join(news, "symbol", "left")
        .join(sector_returns(quotes, proxies).drop("proxy"), "sector", "left")
    )
    df = df.withColumns(
        {
            "sector": F.coalesce("sector", F.lit("Unknown")),
            "company_name": F.coalesce("company_name", "symbol"),
            "fund_score": F.coalesce("fund_score", F.lit(50.0)),
        }
    )
    df = context.add_macro(context.add_sentiment(df), flags)
    total = sum((F.col(f"{k}_score") * F.lit(w) for k, w in t.TOTAL_WEIGHTS.items()), F.lit(0.0))
    df = levels.add_long_levels(df.withColumn("total", rnd(total, 2)))
    df = levels.add_status(df)
    df = df.withColumns({"risk": levels.risk_rating(), "grade": levels.grade("total")})
    texts = F.array_distinct(
        F.concat("tech_signals", fundamental.signals(), context.sentiment_signals(), "macro_signals")
    )
    return df.withColumns(
        {"signals": texts, "timeframes": technical.timeframes(), "advice": levels.long_advice()}
    )


def long_screen(scores: DataFrame, n: int = 10) -> DataFrame:
    return sector_capped_top(scores, n, "total")


def report(ranked: DataFrame) -> DataFrame:
    """Formatted summary row per pick."""
    zone = F.concat(money("zone_low"), F.lit("–"), money("zone_high"))
    return ranked.select(
        "rank",
        "symbol",
        F.substring("company_name", 1, 25).alias("name"),
        money("price").alias("price"),
        F.concat(signed("change_pct", 2), F.lit("%")).alias("change"),
        F.format_string("%.1f", printed("total")).alias("score"),
        "grade",
        F.array_join("timeframes", " | ").alias("timeframes"),
        "status",
        "risk",
        "sector",
        money("entry").alias("entry"),
        zone.alias("entry_zone"),
        money("stop").alias("stop"),
        money("target_1").alias("t1"),
        money("target_2").alias("t2"),
        F.concat(F.format_string("%.1f", printed("risk_reward")), F.lit("x")).alias("rr"),
        *[F.bround(f"{k}_score").cast("int").alias(k) for k in t.TOTAL_WEIGHTS],
        F.array_join("signals", " | ").alias("signals"),
    )


def short_scores(bars: DataFrame, facts: DataFrame, bench: str) -> DataFrame:
    bars = settle(bars)
    p = newest_bear_scores(bars, bench)
    short = F.col("short_history")
    # fixed value: the reason of a name without enough bars
    gates = F.when(short, F.array(F.lit("insufficient history"))).otherwise(bear.gates())
    p = p.withColumns({"gate_reasons": gates, "signals": F.when(short, F.array().cast("array<string>")).otherwise(bear.signals())})
    p = p.withColumns(
        {"tradeable": F.size("gate_reasons") == 0, "atr_pct": F.coalesce(ratio("atr", "close") * 100, F.lit(0.0))}
    )
    p = technical.as_reported(p).withColumns(
        {"dollar_volume": rnd("dollar_volume", 0), "rel_strength": rnd("rel_strength", 2)}
    )
    df = with_quote(p, latest_quotes(bars)).join(
        facts.select(
            "symbol", "company_name", "beta", context.normalise_sector(F.col("raw_sector")).alias("sector")
        ),
        "symbol",
        "left",
    )
    df = levels.add_short_levels(df.withColumn("sector", F.coalesce("sector", F.lit("Unknown"))))
    df = df.withColumn("squeeze", levels.squeeze_risk())
    df = df.withColumns({"setup": levels.setup_quality(), "grade": levels.grade("bear_score")})
    return df.withColumn("advice", levels.short_advice())


def short_screen(scores: DataFrame, n: int = 10) -> DataFrame:
    """Gated names come after the tradeable ones but are not dropped."""
    return sector_capped_top(scores, n, "bear_score", tradeable="tradeable")


def universe_kpis(scores: DataFrame) -> DataFrame:
    """One row of headline figures, in one aggregate."""
    return scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total").alias("mean_score"),
        F.max_by("symbol", F.struct("total", "symbol")).alias("best"),
        F.min_by("symbol", F.struct("total", "symbol")).alias("worst"),
        F.count_if(F.col("total") >= 60).alias("bullish_score"),
        F.count_if(F.col("status").endswith("Bullish")).alias("bullish_status"),
        F.count_if(F.col("status").endswith("Bearish")).alias("bearish_status"),
        F.median("change_pct").alias("median_change"),
        F.max_by("symbol", F.struct("change_pct", "symbol")).alias("leader"),
    )


def sector_rotation(returns: DataFrame) -> DataFrame:
    """Momentum score per sector, and which one leads or lags."""
    ends = returns.agg(
        F.max_by("sector", "sector_return").alias("leading"), F.min_by("sector", "sector_return").alias("lagging")
    )
    return returns.crossJoin(F.broadcast(ends)).withColumn(
        "momentum", context.sector_momentum(F.col("sector_return"))
    )
