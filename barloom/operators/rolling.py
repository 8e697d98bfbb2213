"""Window indicators over an ordered series: built-in expressions only.

Rolling values are NULL until the window holds `n` non-null inputs.
Each `add_*` takes and returns a DataFrame so that it works with DataFrame.transform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, col, ratio
from .ema import add_ema, span_alpha, wilder_alpha
from .series import Series


# ── building blocks ──────────────────────────────────────────────────────────
def full(agg: Column, src: Column | str, n: int, s: Series, skip: int | None = None) -> Column:
    """Rolling aggregate, NULL until the window is full.

    With `skip`, the number of NULLs the input is known to start with (0 for prices), the row number
    decides, which halves the work per window; without it the non-null inputs are counted.
    """
    w = s.last(n)
    if skip is not None and s.index is not None:
        return F.when(col(s.index) >= n - 1 + skip, agg.over(w))
    return F.when(F.count(col(src)).over(w) == n, agg.over(w))


def sma(src: str, n: int, s: Series, skip: int | None = None) -> Column:
    return full(F.avg(src), src, n, s, skip)


def rstd(src: str, n: int, s: Series, skip: int | None = None) -> Column:
    return full(F.stddev_samp(src), src, n, s, skip)


def rmax(src: str, n: int, s: Series, skip: int | None = None) -> Column:
    return full(F.max(src), src, n, s, skip)


def rmin(src: str, n: int, s: Series, skip: int | None = None) -> Column:
    return full(F.min(src), src, n, s, skip)


def lagged(src: Column | str, k: int, s: Series) -> Column:
    return F.lag(col(src), k).over(s.ordered())


def ahead(src: Column | str, k: int, s: Series) -> Column:
    return F.lead(col(src), k).over(s.ordered())


def roc(src: str, k: int, s: Series) -> Column:
    """Fractional change over k rows."""
    return ratio(src, lagged(src, k, s)) - 1


def change(src: str, k: int, s: Series) -> Column:
    return col(src) - lagged(src, k, s)


def true_range(s: Series) -> Column:
    """Range including the gap from the previous close; plain range on the first row."""
    pc = lagged("close", 1, s)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def directional(s: Series) -> tuple[Column, Column]:
    """(+DM, -DM); zero on the first row."""
    up = F.col("high") - lagged("high", 1, s)
    dn = lagged("low", 1, s) - F.col("low")
    plus = F.when((up > dn) & (up > 0), up).otherwise(F.lit(0.0))
    minus = F.when((dn > up) & (dn > 0), dn).otherwise(F.lit(0.0))
    return plus, minus


# ── simple-mean indicators ───────────────────────────────────────────────────
def add_moves(df: DataFrame, s: Series) -> DataFrame:
    """Row-to-row inputs of the other indicators: gain, loss, tr, dm_plus, dm_minus, ret."""
    d = change("close", 1, s)
    plus, minus = directional(s)
    return df.withColumns(
        {
            "gain": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))),
            "loss": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))),
            "tr": true_range(s),
            "dm_plus": plus,
            "dm_minus": minus,
            "ret": roc("close", 1, s),
        }
    )


def rsi_of(up: Column | str, down: Column | str) -> Column:
    """100 - 100/(1 + up/down); NULL when there were no losses."""
    rs = ratio(up, down)
    return F.lit(100.0) - ratio(F.lit(100.0), 1 + rs)


def add_rsi(df: DataFrame, s: Series, n: int = 14, out: str = "rsi") -> DataFrame:
    return df.withColumn(out, rsi_of(sma("gain", n, s, 1), sma("loss", n, s, 1)))


def add_bollinger(df: DataFrame, s: Series, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, sd = sma("close", n, s, 0), rstd("close", n, s, 0)
    return df.withColumns({"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd})


def add_atr(df: DataFrame, s: Series, n: int = 14, out: str = "atr") -> DataFrame:
    return df.withColumn(out, sma("tr", n, s, 0))


def add_stochastic(df: DataFrame, s: Series, k: int = 14, d: int = 3) -> DataFrame:
    lo, hi = rmin("low", k, s, 0), rmax("high", k, s, 0)
    df = df.withColumn("stoch_k", 100 * (F.col("close") - lo) / (hi - lo + F.lit(1e-9)))
    return df.withColumn("stoch_d", sma("stoch_k", d, s, k - 1))


def add_adx(df: DataFrame, s: Series, n: int = 14, out: str = "adx") -> DataFrame:
    """Trend strength from simple rolling means."""
    atr = sma("tr", n, s, 0)
    df = df.withColumns(
        {
            "_dip": 100 * ratio(sma("dm_plus", n, s, 0), atr),
            "_dim": 100 * ratio(sma("dm_minus", n, s, 0), atr),
        }
    )
    df = df.withColumn(
        "_dx",
        100 * F.abs(F.col("_dip") - F.col("_dim")) / (F.col("_dip") + F.col("_dim") + F.lit(1e-9)),
    )
    return df.withColumn(out, sma("_dx", n, s)).drop("_dip", "_dim", "_dx")


def add_volume_ratio(df: DataFrame, s: Series, n: int = 20) -> DataFrame:
    df = df.withColumn("avg_volume", sma("volume", n, s, 0))
    return df.withColumns(
        {
            "vol_ratio": ratio("volume", "avg_volume"),
            "dollar_volume": F.col("close") * F.coalesce(F.col("avg_volume"), F.col("volume")),
        }
    )


def range_position(price: Column | str, hi: Column | str, lo: Column | str) -> Column:
    """Where price sits in [lo, hi] as a fraction."""
    return ratio(col(price) - col(lo), col(hi) - col(lo))


# ── exponential indicators ───────────────────────────────────────────────────
def add_macd(df: DataFrame, s: Series, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = add_ema(
        df, s, {"_fast": ("close", span_alpha(fast)), "_slow": ("close", span_alpha(slow))}
    ).withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = add_ema(df, s, {"macd_signal": ("macd", span_alpha(signal))})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def add_wilder(df: DataFrame, s: Series, n: int = 14) -> DataFrame:
    """Wilder-smoothed RSI, ATR and ADX (alpha = 1/n)."""
    a = wilder_alpha(n)
    df = add_ema(
        df,
        s,
        {
            "_up": ("gain", a),
            "_dn": ("loss", a),
            "atr_w": ("tr", a),
            "_pl": ("dm_plus", a),
            "_mi": ("dm_minus", a),
        },
        late=("gain", "loss"),
    )
    pdi, mdi = 100 * ratio("_pl", "atr_w"), 100 * ratio("_mi", "atr_w")
    df = df.withColumns(
        {
            "rsi_w": rsi_of("_up", "_dn"),
            "_dx": 100 * ratio(F.abs(pdi - mdi), pdi + mdi),
        }
    )
    return add_ema(df, s, {"adx_w": ("_dx", a)}, late=("_dx",)).drop("_up", "_dn", "_pl", "_mi", "_dx")


# ── structure ────────────────────────────────────────────────────────────────
def add_structure(df: DataFrame, s: Series, n: int = 20, k: int = 3, pivot_bar: bool = True) -> DataFrame:
    """Liquidity sweeps, breakouts, gaps, inside bars and break of structure, as 0.0/1.0 flags.

    A pivot is the extreme of the 2k+1 rows around it and is known k rows later.  `pivot_bar` keeps
    the level of the pivot itself; False keeps the level of the confirming row.
    """
    o = s.ordered()
    centred = s.between(-k, k)
    full_window = F.count(F.lit(1)).over(centred) == 2 * k + 1
    df = df.withColumns(
        {
            "_is_ph": full_window & (F.max("high").over(centred) == F.col("high")),
            "_is_pl": full_window & (F.min("low").over(centred) == F.col("low")),
            "_hi": rmax("high", n, s, 0),
            "_lo": rmin("low", n, s, 0),
        }
    )
    level_h = F.lag("high", k).over(o) if pivot_bar else F.col("high")
    level_l = F.lag("low", k).over(o) if pivot_bar else F.col("low")
    df = df.withColumns(
        {
            "_phi": F.lag("_hi", 1).over(o),
            "_plo": F.lag("_lo", 1).over(o),
            "_piv_h": F.when(F.lag("_is_ph", k).over(o), level_h),
            "_piv_l": F.when(F.lag("_is_pl", k).over(o), level_l),
        }
    )
    df = df.withColumns(
        {
            "last_pivot_high": F.last("_piv_h", True).over(s.running()),
            "last_pivot_low": F.last("_piv_l", True).over(s.running()),
        }
    )
    h, l, c = F.col("high"), F.col("low"), F.col("close")

    def flag(cond: Column) -> Column:
        return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))

    df = df.withColumns(
        {
            "s_sweep_hi": flag((h > F.col("_phi")) & (c < F.col("_phi"))),
            "s_sweep_lo": flag((l < F.col("_plo")) & (c > F.col("_plo"))),
            "s_bo_hi": flag(c > F.col("_phi")),
            "s_bo_lo": flag(c < F.col("_plo")),
            "s_fvg_up": flag(l > F.lag("high", 2).over(o)),
            "s_fvg_dn": flag(h < F.lag("low", 2).over(o)),
            "s_bos_up": flag(c > F.col("last_pivot_high")),
            "s_bos_dn": flag(c < F.col("last_pivot_low")),
            "s_inside": flag((h < F.lag("high", 1).over(o)) & (l > F.lag("low", 1).over(o))),
        }
    )
    return df.drop("_is_ph", "_is_pl", "_hi", "_lo", "_phi", "_plo", "_piv_h", "_piv_l")


def add_forward_returns(df: DataFrame, s: Series, horizons: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    return df.withColumns({f"fwd{h}": ratio(ahead("close", h, s), "close") - 1 for h in horizons})


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns({"z_dow": F.weekday(ts), "z_month": F.month(ts)})


# ── trading results ──────────────────────────────────────────────────────────
def add_equity(df: DataFrame, s: Series, pnl: str) -> DataFrame:
    """Running equity, its peak (never below the opening balance of zero) and the drawdown."""
    df = df.withColumn("equity", F.sum(pnl).over(s.running()))
    df = df.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(s.running())))
    return df.withColumn("drawdown", F.col("equity") - F.col("peak"))


def add_losing_run(df: DataFrame, s: Series, win: str) -> DataFrame:
    """Length so far of the current run of rows that are not wins."""
    wins = F.sum(F.when(F.col(win), 1).otherwise(0)).over(s.running())
    df = df.withColumn("_wins", wins)
    island = (
        Window.partitionBy(*s.part, "_wins")
        .orderBy(*s.order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    run = F.sum(F.when(F.col(win), 0).otherwise(1)).over(island)
    return df.withColumn("losing_run", run).drop("_wins")


def clipped_score(c: Column) -> Column:
    return clamp(c, 0.0, 100.0)
