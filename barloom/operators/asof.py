"""Alignment of one series to another by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import ratio
from .ema import add_ema, span_alpha
from .rolling import change, roc, rstd, sma
from .series import Series
from .universe import dollar_volume


def asof_fill(
    bars: DataFrame, s: Series, driver: DataFrame, value: str, limit: int | None = None, out: str | None = None
) -> DataFrame:
    """Join `driver` (ts, value) on ts and carry it forward over at most `limit` rows."""
    out = out or value
    d = driver.select("ts", F.col(value).alias("_x"))
    w = s.running() if limit is None else s.last(limit + 1)
    joined = bars.join(d, "ts", "left")
    return joined.withColumn(out, F.last("_x", True).over(w)).drop("_x")


def trend_features(bars: DataFrame, s: Series, bench: str) -> DataFrame:
    """Trend, momentum, relative strength, risk-adjusted momentum and volume confirmation."""
    b = asof_fill(
        bars, s, bars.where(F.col("symbol") == bench), "close", out="bench_close"
    )
    b = add_ema(
        b,
        s,
        {
            "_e20": ("close", span_alpha(20)),
            "_e50": ("close", span_alpha(50)),
            "_e100": ("close", span_alpha(100)),
        },
    )
    b = b.withColumns(
        {
            "_ret": roc("close", 1, s),
            "roc7": roc("close", 7, s) * 100,
            "roc30": roc("close", 30, s) * 100,
            "bench_roc30": roc("bench_close", 30, s) * 100,
            "dollar_volume": dollar_volume(bars),
        }
    )
    b = b.withColumns(
        {
            "vol30": rstd("_ret", 30, s) * F.sqrt(F.lit(365.0)) * 100,
            "vol_trend": ratio(sma("dollar_volume", 7, s), sma("dollar_volume", 30, s)),
        }
    )
    gap = [ratio("close", e) - 1 for e in ("_e20", "_e50", "_e100")]
    b = b.withColumns(
        {
            "trend": (gap[0] + gap[1] + gap[2]) * 100,
            "mom": F.col("roc7") * 0.4 + F.col("roc30") * 0.6,
            "rel_bench": F.col("roc30") - F.col("bench_roc30"),
            "risk_adj_mom": ratio("roc30", "vol30"),
        }
    )
    return b.drop("_e20", "_e50", "_e100", "_ret")


# fixed values: drivers of the cross-asset block, and those that are rates or levels already
DRIVERS = ("dxy", "tnx", "fvx", "tip", "vix", "spx", "slv", "cop", "oil")
LEVELS = ("tnx", "fvx", "vix")


def cross_features(bars: DataFrame, s: Series, drivers: DataFrame, limit: int = 5) -> DataFrame:
    """`c_*` features of every bar from the daily closes of the drivers (symbol, ts, close).

    The drivers become columns by one pivot over a fixed list and one join on ts; each is carried forward over at most
    `limit` rows, all in one sort.  Rates and levels give differences, the others growth; silver also gives a ratio, and the
    inflation-linked bond with its sign turned round stands for real yields.  A driver without rows gives NULLs.
    """
    wide = drivers.where(F.col("symbol").isin(*DRIVERS)).groupBy("ts").pivot("symbol", list(DRIVERS)).agg(F.max("close"))
    b = bars.join(wide.select("ts", *[F.col(n).alias(f"x_{n}") for n in DRIVERS]), "ts", "left")
    b = b.withColumns({f"x_{n}": F.last(f"x_{n}", True).over(s.last(limit + 1)) for n in DRIVERS})
    b = b.withColumn("c_gold_silver", ratio("close", "x_slv"))
    out = {}
    for n in DRIVERS:
        x = f"x_{n}"
        if n in LEVELS:
            out |= {f"c_{n}_chg5": change(x, 5, s), f"c_{n}_chg20": change(x, 20, s), f"c_{n}_lvl": F.col(x)}
        else:
            out |= {f"c_{n}_roc5": roc(x, 5, s), f"c_{n}_roc20": roc(x, 20, s)}
    out |= {"c_gs_roc20": roc("c_gold_silver", 20, s), "c_realyield_proxy": -roc("x_tip", 20, s)}
    return b.withColumns(out).drop(*[f"x_{n}" for n in DRIVERS])
