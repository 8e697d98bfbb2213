"""Which symbols take part: history, liquidity, proxies, freshness, quotes, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..functions.stats import pearson
from .rolling import roc
from .series import Series

# fixed values
MIN_DOLLAR_VOLUME = 5_000_000.0
MIN_ANNUAL_VOL_PCT = 10.0
MIN_ROWS = 120
STALE_DAYS = 10


def complete(bars: DataFrame) -> DataFrame:
    return bars.dropna(subset=["open", "high", "low", "close"])


def enough_history(bars: DataFrame, n: int) -> DataFrame:
    """Rows of symbols with at least n bars: count, then semi join."""
    ok = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return bars.join(ok, "symbol", "left_semi")


def dollar_volume(bars: DataFrame) -> Column:
    price = F.coalesce(F.col("vwap"), F.col("close")) if "vwap" in bars.columns else F.col("close")
    return F.col("volume") * price


def universe_stats(bars: DataFrame, s: Series) -> DataFrame:
    """Median dollar volume, rows, annualised volatility (per cent) per symbol."""
    return (
        bars.withColumns({"_dv": dollar_volume(bars), "_ret": roc("close", 1, s)})
        .groupBy("symbol")
        .agg(
            F.median("_dv").alias("med_dv"),
            F.count(F.lit(1)).alias("n"),
            (F.stddev_samp("_ret") * F.sqrt(F.lit(365.0)) * 100).alias("ann_vol"),
        )
    )


def passing(
    stats: DataFrame,
    min_dollar_volume: float = MIN_DOLLAR_VOLUME,
    min_vol_pct: float = MIN_ANNUAL_VOL_PCT,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    return stats.where(
        (F.col("med_dv") >= min_dollar_volume)
        & (F.col("ann_vol") >= min_vol_pct)
        & (F.col("n") >= min_rows)
    )


def proxies(bars: DataFrame, s: Series, bench: str, reference: str) -> DataFrame:
    """Symbols whose returns correlate more with `reference` than with `bench` (long form, no pivot)."""
    r = bars.select("symbol", "ts", roc("close", 1, s).alias("_r"))
    b = r.where(F.col("symbol") == bench).select("ts", F.col("_r").alias("_rb"))
    g = r.where(F.col("symbol") == reference).select("ts", F.col("_r").alias("_rg"))
    c = (
        r.join(b, "ts", "left")
        .join(g, "ts", "left")
        .groupBy("symbol")
        .agg(pearson("_r", "_rb").alias("cb"), pearson("_r", "_rg").alias("cg"))
    )
    return c.where((F.col("symbol") != bench) & (F.col("cg") > F.col("cb")))


def apply_universe(
    bars: DataFrame, s: Series, bench: str, reference: str, **limits: float
) -> DataFrame:
    """Liquidity and peg filter, then the proxy filter on the survivors."""
    kept = bars.join(passing(universe_stats(bars, s), **limits), "symbol", "left_semi")
    with_ref = bars.where(F.col("symbol") == reference)
    probe = kept.where(F.col("symbol") != reference).unionByName(with_ref)
    return kept.join(proxies(probe, s, bench, reference), "symbol", "left_anti")


def candidates(bars: DataFrame, on: str, back: int, suffix: str, n: int) -> DataFrame:
    """Top n by dollar volume on the newest non-empty day in the `back` days up to `on`."""
    end = F.lit(on).cast("timestamp")
    window = bars.where(
        (F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {back} DAYS"))
    )
    day = window.agg(F.max("ts").alias("ts"))
    picked = (
        window.join(F.broadcast(day), "ts", "left_semi")
        .where(F.col("symbol").endswith(suffix))
        .withColumn("dollar_volume", dollar_volume(bars))
    )
    from .cross import top_n

    return top_n(picked, n, F.col("dollar_volume").desc(), F.col("symbol"))


def freshness(membership: DataFrame, bars: DataFrame, asof: str, stale: int = STALE_DAYS) -> DataFrame:
    """Per symbol the lists naming it and OK / STALE / DEAD."""
    names = membership.groupBy("symbol").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists")
    )
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    age = F.datediff(F.lit(asof).cast("date"), F.col("last_ts").cast("date"))
    state = F.when(F.col("last_ts").isNull(), "DEAD").when(age > stale, "STALE").otherwise("OK")
    return names.join(last, "symbol", "left").withColumn("state", state)


def latest_quotes(bars: DataFrame) -> DataFrame:
    """Last bar and change against the bar before, for symbols with two bars.

    The two newest rows per symbol are kept by a rank filter that Spark applies before the shuffle.
    """
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    two = bars.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 2)

    def at(c: str, rn: int) -> Column:
        return F.max(F.when(F.col("_rn") == rn, F.col(c)))

    out = two.groupBy("symbol").agg(
        at("close", 1).alias("price"),
        at("open", 1).alias("open"),
        at("high", 1).alias("high"),
        at("low", 1).alias("low"),
        at("volume", 1).alias("volume"),
        at("close", 2).alias("prev_close"),
    )
    return out.where(F.col("prev_close").isNotNull()).withColumn(
        "change_pct", ratio(F.col("price") - F.col("prev_close"), "prev_close") * 100
    )


def valid_price(quotes: DataFrame, bars: DataFrame) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"))
    price = F.coalesce(F.when(F.col("quote") > 0, F.col("quote")), F.col("last_close"))
    return (
        quotes.join(last, "symbol", "left")
        .withColumn("price", price)
        .where(F.col("last_close").isNotNull() & (F.col("price") > 0))
    )


def universe(*lists: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), lists).distinct()


def first_places(asked: DataFrame) -> DataFrame:
    """Order-preserving removal of repeats: the first position of every name."""
    return asked.groupBy("symbol").agg(F.min("pos").alias("first_pos"))


def not_scored(asked: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    from .cross import top_n

    left = asked.join(scored.select("symbol").distinct(), "symbol", "left_anti")
    return top_n(left, n, F.col("first_pos"), F.col("symbol")).withColumnRenamed("rank", "place")


def spread_distribution(ticks: DataFrame, spread: str, target: float) -> DataFrame:
    """Exact spread percentiles per symbol, and the share of a target the median spread takes.

    Spreads are counted per value first, so the percentile of a symbol holds as many values as the tick grid has, never ticks.
    """
    counted = ticks.where(F.col(spread) > 0).groupBy("symbol", F.col(spread).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    at = lambda p: F.percentile("_v", F.lit(p), F.col("_k"))
    out = counted.groupBy("symbol").agg(
        F.sum("_k").alias("n"), at(0.5).alias("median_spread"), (F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("mean_spread"),
        at(0.9).alias("p90_spread"), at(0.99).alias("p99_spread"),
    )
    return out.withColumn("share_of_target", F.col("median_spread") / F.lit(float(target)) * 100)
