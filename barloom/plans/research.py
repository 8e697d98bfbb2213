"""Research plans built from the operators: stop selection, feature scan, grids, live cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import tables as t
from ..functions.num import ratio, reasons
from ..operators import rolling as W
from ..operators.asof import cross_features
from ..operators.cross import average_rank
from ..operators.ema import add_ema, span_alpha, wilder_alpha
from ..operators.ranks import expanding_rank, rolling_rank
from ..operators.series import Series
from ..operators.sessions import expected_move, profile_of, vol_state
from ..operators.settle import settle

STOPS = (0.25, 0.35, 0.50, 0.75, 1.00, 1.50, None)  # fixed values: multiples of ATR, None is no stop


def with_atr_trend(bars: DataFrame, s: Series, same_bar: bool = False) -> DataFrame:
    """Wilder ATR(24) and EMA(200) of the row before, and whether price is above that average.

    The trend test uses the previous close, which is known at the open; same_bar=True uses the bar's
    own close instead.
    """
    b = add_ema(
        bars.withColumn("_tr", W.true_range(s)),
        s,
        {"_atr": ("_tr", wilder_alpha(24)), "_e200": ("close", span_alpha(200))},
    )
    b = b.withColumns(
        {"atr": W.lagged("_atr", 1, s), "ema200": W.lagged("_e200", 1, s), "_pc": W.lagged("close", 1, s)}
    )
    px = F.col("close") if same_bar else F.col("_pc")
    return b.withColumn("above200", px > F.col("ema200")).drop("_tr", "_atr", "_e200", "_pc")


def stop_trades(signals: DataFrame, spread: float, stops: tuple[float | None, ...] = STOPS) -> DataFrame:
    """Same-bar trades for every stop: buy the open, leave at the stop if the low reaches it, else at
    the close, half the spread on each side.  The grid is a fixed handful of values per signal."""
    grid = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(k).cast("double").alias("k")) for i, k in enumerate(stops)]
    )
    df = signals.withColumn("_g", F.explode(grid))
    entry = F.col("open") + spread / 2
    stop = entry - F.col("_g.k") * F.col("atr")
    left = F.when(F.col("low") <= stop, stop).otherwise(F.col("close")) - spread / 2
    return df.withColumns({"stop_i": F.col("_g.i"), "stop_k": F.col("_g.k"), "net": left - entry}).drop("_g")


def walk_forward_stop(trades: DataFrame, min_past: int = 200, min_now: int = 30) -> DataFrame:
    """Each year trades the stop with the best return over drawdown on all years before it.

    One running pass per (symbol, stop) gives equity and drawdown; a year's past is then the running
    aggregate of the yearly figures, never a join of years with earlier rows.
    """
    run = Series(keys=("symbol", "stop_i"), part=("symbol", "stop_i"), order=("ts",))
    df = W.add_equity(trades.withColumn("year", F.year("ts")), run, "net")
    yearly = df.groupBy("symbol", "stop_i", "stop_k", "year").agg(
        F.count("net").alias("n"),
        F.sum("net").alias("total"),
        st.hit("net").alias("win"),
        st.t_one("net").alias("t"),
        F.min("drawdown").alias("_dd"),
    )
    past = (
        Window.partitionBy("symbol", "stop_i")
        .orderBy("year")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    yearly = yearly.withColumns(
        {
            "_n0": F.sum("n").over(past),
            "_t0": F.sum("total").over(past),
            "_d0": F.min("_dd").over(past),
            "_y0": F.count(F.lit(1)).over(past),
        }
    )
    ok = yearly.where((F.col("_y0") >= 2) & (F.col("_n0") >= min_past) & (F.col("n") >= min_now))
    no_dd = F.when((F.col("_d0") == 0) & (F.col("_t0") > 0), F.lit(float("inf")))
    calmar = F.when(F.col("_t0") > 0, F.coalesce(no_dd, ratio("_t0", -F.col("_d0"))))
    # nothing qualifies: the row without a stop is taken
    best = Window.partitionBy("symbol", "year").orderBy(
        F.col("_calmar").isNull(),
        F.col("_calmar").desc(),
        F.when(F.col("_calmar").isNull(), F.col("stop_k").isNotNull()),
        "stop_i",
    )
    picked = ok.withColumn("_calmar", calmar).withColumn("_rn", F.row_number().over(best))
    return picked.where(F.col("_rn") == 1).select("symbol", "year", "stop_k", "n", "win", "total", "t")


def feature_panel(bars: DataFrame, s: Series, drivers: DataFrame | None = None, min_rank: int = 249) -> DataFrame:
    """Trend, momentum, reversion, volatility, structure and calendar features with forward returns.

    `v_atr_rank` is the share of earlier bars with a smaller `v_atr_pct`, from `min_rank` earlier bars on.  With `drivers` (symbol, ts, close;
    see `asof.cross_features`) the cross-asset block is added.
    """
    b = W.add_wilder(W.add_moves(bars, s), s)
    b = add_ema(b, s, {f"_e{n}": ("close", span_alpha(n)) for n in (20, 50, 200)})
    b = W.add_bollinger(b, s)
    b = b.withColumns(
        {
            **{f"t_px_ema{n}": ratio("close", f"_e{n}") - 1 for n in (20, 50, 200)},
            "t_ema50_200": ratio("_e50", "_e200") - 1,
            "t_adx": F.col("adx_w"),
            **{f"m_roc{n}": W.roc("close", n, s) for n in (5, 10, 20, 60)},
            "r_rsi14": F.col("rsi_w"),
            "r_bb_pos": W.range_position("close", "bb_upper", "bb_lower"),
            "r_from_hi20": ratio("close", W.rmax("high", 20, s)) - 1,
            "r_from_lo20": ratio("close", W.rmin("low", 20, s)) - 1,
            "v_atr_pct": ratio("atr_w", "close"),
            "v_rvol20": W.rstd("ret", 20, s),
            "atr_at_t": F.col("atr_w"),
        }
    )
    b = W.add_calendar(W.add_structure(b, s))
    b = W.add_forward_returns(b, s)
    if drivers is not None:
        b = cross_features(b, s, drivers)
    b = expanding_rank(b, s, "v_atr_pct", "v_atr_rank", min_obs=min_rank)
    return b.drop("gain", "loss", "tr", "dm_plus", "dm_minus", "_e20", "_e50", "_e200", "bb_mid", "bb_upper", "bb_lower")


GROUPS = {
    "t": "trend", "m": "momentum", "r": "meanrev", "v": "volatility", "s": "structure", "c": "crossasset", "z": "seasonal",
}


def feature_group(name: str = "feature"):
    pairs = [x for k, v in GROUPS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.substring_index(F.col(name), "_", 1)]


def feature_scan(
    panel: DataFrame, s: Series, continuous: list[str], flags: list[str], horizons: tuple[int, ...] = (5, 10, 20),
    min_rank: int = 250,
) -> DataFrame:
    """Each feature and horizon on non-overlapping rows: rank correlation and tercile effect for
    continuous features, event against non-event for flags."""
    # the rank looks back only and the rows a horizon drops are the last ones, so one pass serves all
    panel = panel.withColumn("_n", F.row_number().over(s.ordered()) - 1)
    fwds = [f"fwd{h}" for h in horizons]
    long = panel.unpivot(["symbol", "ts", "_n", *fwds], continuous, "feature", "value")
    keyed = Series(keys=("symbol", "feature"), part=("symbol", "feature"), order=("ts",))
    long = long.where(F.col("value").isNotNull())
    long = settle(expanding_rank(long, keyed, "value", "_pct", min_obs=min_rank))
    parts = []
    for h, fwd in zip(horizons, fwds):
        kept = F.col(fwd).isNotNull() & (F.col("_n") % h == 0)
        ev = panel.where(kept).unpivot(["symbol", fwd], flags, "feature", "value")
        a, b = F.when(F.col("value") == 1, F.col(fwd)), F.when(F.col("value") == 0, F.col(fwd))
        tv, dof = st.welch(a, b)
        parts.append(
            ev.groupBy("symbol", "feature").agg(
                F.lit(h).alias("h"), F.lit("event").alias("kind"), F.count(a).alias("n"),
                (F.avg(a) - F.avg(b)).alias("effect"), tv.alias("t"), dof.alias("dof"),
                F.lit(None).cast("double").alias("rho"),
            )
        )
        cs = long.where(kept).select("symbol", "feature", "value", "_pct", fwd)
        by = ["symbol", "feature"]
        ranked = average_rank(average_rank(cs, by, "value", "_rx"), by, fwd, "_ry")
        rho = st.pearson("_rx", "_ry")
        top, low = F.when(F.col("_pct") >= 0.7, F.col(fwd)), F.when(F.col("_pct") <= 0.3, F.col(fwd))
        enough = (F.count(top) > 10) & (F.count(low) > 10)
        parts.append(
            ranked.groupBy("symbol", "feature").agg(
                F.lit(h).alias("h"), F.lit("cont").alias("kind"), F.count(F.lit(1)).alias("n"),
                F.when(enough, F.avg(top) - F.avg(low)).alias("effect"),
                st.corr_t(rho, F.count(F.lit(1)), 1e-9).alias("t"),
                (F.count(F.lit(1)) - 2).cast("double").alias("dof"), rho.alias("rho"),
            )
        )
    out = reduce(lambda x, y: x.unionByName(y), parts)
    strongest = Window.partitionBy("symbol", "h").orderBy(F.abs("t").desc_nulls_last(), "feature")  # one row per feature
    return out.withColumns({"group": feature_group(), "rank": F.row_number().over(strongest)})


def top_features(scan: DataFrame, n: int = 14) -> DataFrame:
    """The `n` features with the largest t in size, per symbol and horizon, strongest first."""
    return scan.where(F.col("rank") <= n).orderBy("symbol", "h", "rank")


def lead_lag(bars: DataFrame, s: Series, lags: tuple[int, ...], spread: float, min_n: int) -> DataFrame:
    """Past against next move on non-overlapping rows for every (look-back, forward) pair, with the
    dollar size of a one-sigma move next to the spread."""
    b = bars.withColumns(
        {
            **{f"_p{k}": ratio("close", W.lagged("close", k, s)) - 1 for k in lags},
            **{f"_f{k}": ratio(W.ahead("close", k, s), "close") - 1 for k in lags},
        }
    )
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(x).alias("lb"), F.lit(y).alias("fw"), F.col(f"_p{x}").alias("p"), F.col(f"_f{y}").alias("f"))
                for x in lags
                for y in lags
            ]
        )
    )
    long = b.select("symbol", "ts", "close", pairs.alias("x")).select("symbol", "ts", "close", "x.*")
    price = bars.groupBy("symbol").agg(F.avg("close").alias("_px"))
    long = long.where(F.col("p").isNotNull() & F.col("f").isNotNull())
    w = Window.partitionBy("symbol", "lb", "fw").orderBy("ts")
    step = F.greatest("lb", "fw")
    sample = long.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % step == 0)
    r = st.pearson("p", "f")
    out = sample.groupBy("symbol", "lb", "fw").agg(
        F.count(F.lit(1)).alias("n"), r.alias("corr"), F.stddev_samp("f").alias("_sf"),
        st.corr_t(r, F.count(F.lit(1))).alias("t"),
    )
    out = out.where(F.col("n") >= min_n).join(price, "symbol")
    usd = F.abs(F.col("corr") * F.col("_sf")) * F.col("_px")
    out = out.withColumns({"edge_usd": usd, "vs_spread": usd / spread, "p": st.t_pvalue("t", (F.col("n") - 2).cast("double"))})
    # fixed values: the limits and texts of the verdict
    verdict = F.when(F.col("p") >= 0.01, "no signal").when(F.col("vs_spread") > 1.5, "TRADEABLE").otherwise("too small vs spread")
    return out.withColumn("verdict", verdict).drop("_sf", "_px")


def volatility_regimes(bars: DataFrame, s: Series, n: int, min_obs: int, look: int, fwd: int, vol: int, min_n: int) -> DataFrame:
    """Past-against-next correlation within terciles of the rolling volatility rank."""
    b = bars.withColumn("_ret", W.roc("close", 1, s))
    b = b.withColumns(
        {"_rv": W.rstd("_ret", vol, s), "p": W.roc("close", look, s), "f": ratio(W.ahead("close", fwd, s), "close") - 1}
    )
    b = rolling_rank(b, s, "_rv", "v", n=n, min_obs=min_obs)
    b = b.where(F.col("v").isNotNull() & F.col("p").isNotNull() & F.col("f").isNotNull())
    w = Window.partitionBy("symbol").orderBy("ts")
    b = b.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % fwd == 0)
    regime = F.when(F.col("v") < 0.33, "low").when(F.col("v") < 0.67, "mid").otherwise("high")
    r = st.pearson("p", "f")
    return (
        b.withColumn("regime", regime)
        .groupBy("symbol", "regime")
        .agg(F.count(F.lit(1)).alias("n"), r.alias("corr"), st.corr_t(r, F.count(F.lit(1))).alias("t"))
        .where(F.col("n") >= min_n)
    )


def bias_card(bars: DataFrame, s: Series, spread: float = t.SPREAD_MEDIAN, min_bars: int = 210) -> DataFrame:
    """Per bar: bias from price against EMA50 and EMA200, levels from 1.5 ATR, and warnings.

    Needs hour and dow (exchange time).  Bars before the `min_bars`-th of a symbol keep their row with the status
    "short history" and without a bias, a direction or levels.
    """
    b = add_ema(
        bars.withColumn("_tr", W.true_range(s)),
        s,
        {"ema50": ("close", span_alpha(50)), "ema200": ("close", span_alpha(200)), "atr": ("_tr", wilder_alpha(24))},
    )
    c, px = F.col, F.col("close")
    over, under = (px > c("ema200")) & (px > c("ema50")), (px < c("ema200")) & (px < c("ema50"))
    enough = F.row_number().over(s.ordered()) >= min_bars
    b = b.withColumns(
        {
            "status": F.when(enough, "ok").otherwise("short history"),
            "bias": F.when(enough, F.when(over, "BULLISH").when(under, "BEARISH").otherwise("MIXED")),
            "dirn": F.when(enough, F.when(over, 1).when(under, -1).when(px > c("ema200"), 1).otherwise(-1)),
            "risk": 1.5 * c("atr"),
        }
    )
    warn = reasons(
        (c("dow") == 4, "friday"),
        (c("hour") == 17, "halt"),
        (c("hour") == 16, "before halt"),
        ((c("risk") != 0) & (2.0 * c("risk") < spread / 0.05), "spread share"),
    )
    return b.withColumns(
        {
            "stop": px - c("dirn") * c("risk"),
            "tp1": px + c("dirn") * 2.0 * c("risk"),
            "tp2": px + c("dirn") * 3.0 * c("risk"),
            "tight_stop": px - c("dirn") * 0.5 * c("atr"),
            "vol_x": profile_of(c("hour")),
            "vol_state": vol_state(profile_of(c("hour"))),
            "expected_move": expected_move(px, c("hour")),
            "chg_24": ratio("close", W.lagged("close", 24, s)) - 1,
            "warnings": warn,
        }
    ).drop("_tr")


def basis_shift(card: DataFrame, live: str = "live_price") -> DataFrame:
    """Move every level of a card by the difference between a live price and the card's price."""
    by = F.col(live) - F.col("close")
    return card.withColumns(
        {c: F.col(c) + by for c in ("stop", "tp1", "tp2", "tight_stop", "ema50", "ema200")}
    ).withColumn("basis_shift", by)


def drift(bars: DataFrame) -> DataFrame:
    """Annualised growth from the first to the last close of each symbol over the years its bars span."""
    years = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / (365.25 * 86400)
    ends = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("_a"), F.max_by("close", "ts").alias("_b"), years.alias("years"))
    return ends.select("symbol", "years", (F.pow(ratio("_b", "_a"), ratio(F.lit(1.0), "years")) - 1).alias("cagr"))


def sign_stability(train: DataFrame, holdout: DataFrame, by: list[str]) -> DataFrame:
    """Join two summaries (mean, t) and say whether the sign held."""
    a = train.select(*by, F.col("mean").alias("train_mean"), F.col("t").alias("train_t"))
    b = holdout.select(*by, F.col("mean").alias("holdout_mean"), F.col("t").alias("holdout_t"))
    held = F.signum("train_mean") == F.signum("holdout_mean")
    verdict = (
        F.when(held & (F.col("holdout_mean") > 0) & (F.abs("holdout_t") > 1.96), "survives")
        .when(held & (F.col("holdout_mean") > 0), "same direction")
        .otherwise("fails")
    )
    return a.join(b, by).withColumns({"sign_held": held, "verdict": verdict})
