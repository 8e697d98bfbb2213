"""Ordered-series indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import ratio, shown
from ..operators import asof as J
from ..operators import ranks as K
from ..operators import rolling as W
from ..operators.ema import add_ema, span_alpha, wilder_alpha
from ..operators.series import plain, segmented
from ..sources import tables as T
from . import sqlbits as q
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins
S = plain()
# raw prices end in exact halves at six places, so they are shown with eight
RAW = {c: 8 for c in ('high20', 'hi52', 'lo52', 'x_lvl')}


def _out(df: DataFrame, cols: list[str], places: int = 4) -> DataFrame:
    return df.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
        *[shown(c, RAW.get(c, places)).alias(c) for c in cols],
    )


def _sql_out(cols: list[str], places: int = 4) -> str:
    return f"symbol, {q.minute('ts')} AS ts, " + ", ".join(
        f"{q.r(c, RAW.get(c, places))} AS {c}" for c in cols
    )


_ROLL = [
    "rsi", "bb_mid", "bb_upper", "bb_lower", "bb_pos", "atr", "stoch_k", "stoch_d", "adx", "roc5",
    "roc20", "vol_ratio", "rvol20", "rvol30", "from_hi20", "from_lo20", "high20", "hi52", "lo52", "pos52",
]
_ROLL_SQL = f"""
WITH b AS ({q.numbered(f'({q.LI_W})')}), m AS ({q.moves('b')}),
a AS (SELECT *,
  {q.roll('avg', 'gain', 14)} AS ag, {q.roll('avg', 'loss', 14)} AS al,
  {q.roll('avg', 'close', 20)} AS bb_mid, {q.roll('stddev_samp', 'close', 20)} AS sd20,
  {q.roll('avg', 'tr', 14)} AS atr, {q.roll('min', 'low', 14)} AS lo14, {q.roll('max', 'high', 14)} AS hi14,
  {q.roll('avg', 'dm_plus', 14)} AS dp, {q.roll('avg', 'dm_minus', 14)} AS dm,
  {q.roll('avg', 'volume', 20)} AS avg_volume, {q.roll('stddev_samp', 'ret', 20)} AS rvol20,
  {q.roll('stddev_samp', 'ret', 30)} * sqrt(365) * 100 AS rvol30,
  {q.roll('max', 'high', 20)} AS high20, {q.roll('min', 'low', 20)} AS low20,
  {q.roll('max', 'high', 52)} AS hi52, {q.roll('min', 'low', 52)} AS lo52,
  (close / NULLIF({q.lag('close', 5)}, 0) - 1) * 100 AS roc5,
  (close / NULLIF({q.lag('close', 20)}, 0) - 1) * 100 AS roc20 FROM m),
c AS (SELECT *, 100 - 100 / (1 + ag / NULLIF(al, 0)) AS rsi,
  bb_mid + 2 * sd20 AS bb_upper, bb_mid - 2 * sd20 AS bb_lower,
  (close - (bb_mid - 2 * sd20)) / NULLIF(4 * sd20, 0) AS bb_pos,
  100 * (close - lo14) / (hi14 - lo14 + 1e-9) AS stoch_k,
  100 * dp / NULLIF(atr, 0) AS dip, 100 * dm / NULLIF(atr, 0) AS dim,
  volume / NULLIF(avg_volume, 0) AS vol_ratio, close / NULLIF(high20, 0) - 1 AS from_hi20,
  close / NULLIF(low20, 0) - 1 AS from_lo20, (close - lo52) / NULLIF(hi52 - lo52, 0) AS pos52 FROM a),
e AS (SELECT *, 100 * abs(dip - dim) / (dip + dim + 1e-9) AS dx FROM c),
f AS (SELECT *, {q.roll('avg', 'stoch_k', 3)} AS stoch_d, {q.roll('avg', 'dx', 14)} AS adx FROM e)
SELECT {_sql_out(_ROLL)} FROM f"""


@R.add("rolling_indicators", _ROLL_SQL)
def rolling_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Simple-mean indicators on weekly bars per supplier."""
    b, s = segmented(T.bars_li_w(spark, d), S)
    b = W.add_moves(b, s)
    b = W.add_rsi(b, s)
    b = W.add_bollinger(b, s)
    b = W.add_atr(b, s)
    b = W.add_stochastic(b, s)
    b = W.add_adx(b, s)
    b = W.add_volume_ratio(b, s)
    b = b.withColumns(
        {
            "roc5": W.roc("close", 5, s) * 100,
            "roc20": W.roc("close", 20, s) * 100,
            "rvol20": W.rstd("ret", 20, s, 1),
            "rvol30": W.rstd("ret", 30, s, 1) * F.sqrt(F.lit(365.0)) * 100,
            "high20": W.rmax("high", 20, s, 0),
            "low20": W.rmin("low", 20, s, 0),
            "hi52": W.rmax("high", 52, s, 0),
            "lo52": W.rmin("low", 52, s, 0),
        }
    )
    b = b.withColumns(
        {
            "bb_pos": W.range_position("close", "bb_upper", "bb_lower"),
            "from_hi20": ratio("close", "high20") - 1,
            "from_lo20": ratio("close", "low20") - 1,
            "pos52": W.range_position("close", "hi52", "lo52"),
        }
    )
    return _out(b, _ROLL)


_EMA = {
    "e9": ("close", span_alpha(9)), "e12": ("close", span_alpha(12)), "e26": ("close", span_alpha(26)),
    "e200": ("close", span_alpha(200)), "gup": ("gain", wilder_alpha(14)), "gdn": ("loss", wilder_alpha(14)),
    "atrw": ("tr", wilder_alpha(14)), "atr24": ("tr", wilder_alpha(24)),
    "pl": ("dm_plus", wilder_alpha(14)), "mi": ("dm_minus", wilder_alpha(14)),
}
_EMA_OUT = ["e9", "e200", "macd", "macd_signal", "macd_hist", "prev_hist", "rsi_w", "atr_w", "atr24_lag", "adx_w"]
_EMA_SQL = f"""
WITH b AS ({q.numbered(f'({q.LI_D})')}), m AS MATERIALIZED ({q.moves('b')}),
e AS MATERIALIZED {q.ema_rec('m', _EMA, macd=True)},
g AS MATERIALIZED (SELECT m.symbol, m.ts, e.*  EXCLUDE (symbol),
      100 - 100 / (1 + gup / NULLIF(gdn, 0)) AS rsi_w,
      100 * abs(100 * pl / NULLIF(atrw, 0) - 100 * mi / NULLIF(atrw, 0))
          / NULLIF(100 * pl / NULLIF(atrw, 0) + 100 * mi / NULLIF(atrw, 0), 0) AS dx
      FROM m JOIN e USING (symbol, pos)),
x AS MATERIALIZED {q.ema_rec('g', {'adx_w': ('dx', wilder_alpha(14))})},
z AS (SELECT g.*, x.adx_w, macd - sig AS macd_hist, sig AS macd_signal, atrw AS atr_w,
      {q.lag('macd - sig').replace('symbol ORDER BY ts', 'g.symbol ORDER BY g.ts')} AS prev_hist,
      {q.lag('atr24').replace('symbol ORDER BY ts', 'g.symbol ORDER BY g.ts')} AS atr24_lag
      FROM g JOIN x USING (symbol, pos))
SELECT {_sql_out(_EMA_OUT)} FROM z"""


@R.add("exponential_indicators", _EMA_SQL)
def exponential_indicators(spark: SparkSession, d: str) -> DataFrame:
    """EMA, MACD and Wilder-smoothed RSI, ATR, ADX on long daily series."""
    b = W.add_moves(T.bars_li_d(spark, d), S)
    b = add_ema(
        b,
        S,
        {
            "e9": ("close", span_alpha(9)),
            "e200": ("close", span_alpha(200)),
            "atr24": ("tr", wilder_alpha(24)),
        },
    )
    b = W.add_wilder(W.add_macd(b, S), S)
    b = b.withColumns(
        {"prev_hist": W.lagged("macd_hist", 1, S), "atr24_lag": W.lagged("atr24", 1, S)}
    )
    return _out(b, _EMA_OUT)


_FLAGS = [
    "s_sweep_hi", "s_sweep_lo", "s_bo_hi", "s_bo_lo", "s_fvg_up", "s_fvg_dn", "s_bos_up", "s_bos_dn", "s_inside",
]
_CEN = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


STRUCT_CTES = f"""
WITH b AS ({q.numbered(f'({q.LI_D})')}),
p AS (SELECT *, count(*) {_CEN} = 7 AND max(high) {_CEN} = high AS ph,
        count(*) {_CEN} = 7 AND min(low) {_CEN} = low AS pl,
        {q.roll('max', 'high', 20)} AS hi20, {q.roll('min', 'low', 20)} AS lo20 FROM b),
l AS (SELECT *, {q.lag('hi20')} AS phi, {q.lag('lo20')} AS plo,
        CASE WHEN {q.lag('ph', 3)} THEN {q.lag('high', 3)} END AS vh,
        CASE WHEN {q.lag('pl', 3)} THEN {q.lag('low', 3)} END AS vl,
        {q.lag('high', 2)} AS h2, {q.lag('low', 2)} AS l2, {q.lag('high')} AS h1, {q.lag('low')} AS l1 FROM p),
v AS (SELECT *, last_value(vh IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS lph,
        last_value(vl IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS lpl FROM l)"""
STRUCT_FLAGS = """CASE WHEN high > phi AND close < phi THEN 1.0 ELSE 0.0 END AS s_sweep_hi,
  CASE WHEN low < plo AND close > plo THEN 1.0 ELSE 0.0 END AS s_sweep_lo,
  CASE WHEN close > phi THEN 1.0 ELSE 0.0 END AS s_bo_hi, CASE WHEN close < plo THEN 1.0 ELSE 0.0 END AS s_bo_lo,
  CASE WHEN low > h2 THEN 1.0 ELSE 0.0 END AS s_fvg_up, CASE WHEN high < l2 THEN 1.0 ELSE 0.0 END AS s_fvg_dn,
  CASE WHEN close > lph THEN 1.0 ELSE 0.0 END AS s_bos_up, CASE WHEN close < lpl THEN 1.0 ELSE 0.0 END AS s_bos_dn,
  CASE WHEN high < h1 AND low > l1 THEN 1.0 ELSE 0.0 END AS s_inside"""
_STRUCT_SQL = f"""{STRUCT_CTES}
SELECT symbol, {q.minute('ts')} AS ts, {q.r('lph', 8)} AS last_pivot_high, {q.r('lpl', 8)} AS last_pivot_low,
  {STRUCT_FLAGS}
FROM v"""


@R.add("structure_flags", _STRUCT_SQL.replace("1.0 ELSE 0.0", "1.0::DOUBLE ELSE 0.0::DOUBLE"))
def structure_flags(spark: SparkSession, d: str) -> DataFrame:
    b = W.add_structure(T.bars_li_d(spark, d), S)
    return b.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
        shown("last_pivot_high", 8).alias("last_pivot_high"),
        shown("last_pivot_low", 8).alias("last_pivot_low"),
        *_FLAGS,
    )


_FWD = ["fwd1", "fwd5", "fwd10", "fwd20", "roc7", "roc30"]


@R.add(
    "forward_returns",
    f"""WITH b AS ({q.LI_W})
        SELECT symbol, {q.minute('ts')} AS ts,
          {', '.join(f"{q.r(f'{q.lead(chr(99) + "lose", h)} / NULLIF(close, 0) - 1')} AS fwd{h}" for h in (1, 5, 10, 20))},
          {q.r(f'close / NULLIF({q.lag("close", 7)}, 0) - 1')} AS roc7,
          {q.r(f'close / NULLIF({q.lag("close", 30)}, 0) - 1')} AS roc30,
          CAST(isodow(ts) - 1 AS INTEGER) AS z_dow, CAST(month(ts) AS INTEGER) AS z_month FROM b""",
)
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    b = W.add_forward_returns(T.bars_li_w(spark, d), S)
    b = W.add_calendar(b.withColumns({"roc7": W.roc("close", 7, S), "roc30": W.roc("close", 30, S)}))
    return b.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
        *[shown(c).alias(c) for c in _FWD],
        "z_dow",
        "z_month",
    )


_TREND = ["trend", "mom", "rel_bench", "risk_adj_mom", "vol_trend"]
_TREND_EMA = {"e20": ("close", span_alpha(20)), "e50": ("close", span_alpha(50)), "e100": ("close", span_alpha(100))}
TREND_CTES = f"""
b AS MATERIALIZED ({q.numbered(f'({q.LI_W})')}),
e AS MATERIALIZED {q.ema_rec('b', _TREND_EMA)},
bench AS (SELECT ts, close AS bclose FROM b WHERE symbol = 'S1'),
j AS (SELECT b.*, e20, e50, e100, bclose, close / NULLIF({q.lag('close').replace('symbol', 'b.symbol').replace('BY ts', 'BY b.ts')}, 0) - 1 AS ret
      FROM b JOIN e USING (symbol, pos) LEFT JOIN bench USING (ts)),
j2 AS (SELECT *, last_value(bclose IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS bfill FROM j),
k AS (SELECT *, (close / NULLIF({q.lag('close', 7)}, 0) - 1) * 100 AS roc7,
      (close / NULLIF({q.lag('close', 30)}, 0) - 1) * 100 AS roc30,
      (bfill / NULLIF({q.lag('bfill', 30)}, 0) - 1) * 100 AS broc30,
      {q.roll('stddev_samp', 'ret', 30)} * sqrt(365) * 100 AS vol30,
      volume * close AS dollar_volume FROM j2),
t AS (SELECT *, (close / NULLIF(e20, 0) - 1 + close / NULLIF(e50, 0) - 1 + close / NULLIF(e100, 0) - 1) * 100 AS trend,
      0.4 * roc7 + 0.6 * roc30 AS mom, roc30 - broc30 AS rel_bench, roc30 / NULLIF(vol30, 0) AS risk_adj_mom,
      ({q.roll('avg', 'dollar_volume', 7)}) / NULLIF({q.roll('avg', 'dollar_volume', 30)}, 0) AS vol_trend FROM k)"""


@R.add("trend_features", f"WITH {TREND_CTES} SELECT {_sql_out(_TREND)} FROM t")
def trend_features(spark: SparkSession, d: str) -> DataFrame:
    return _out(J.trend_features(T.bars_li_w(spark, d), S, bench="S1"), _TREND)


_CROSS_OUT = ["x_chg5", "x_lvl", "x_roc20", "px_over_x", "pxx_roc20", "inv_roc20"]


@R.add(
    "cross_asset_features",
    f"""WITH b AS ({q.LI_D}),
        x AS (SELECT ts, close AS xc FROM b WHERE symbol = 'AF'),
        j AS (SELECT b.*, xc FROM b LEFT JOIN x USING (ts)),
        f AS (SELECT *, last_value(xc IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
                         ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS xf FROM j),
        g AS (SELECT *, close / NULLIF(xf, 0) AS px_over_x FROM f)
        SELECT symbol, {q.minute('ts')} AS ts, {q.r(f'xf - {q.lag("xf", 5)}')} AS x_chg5, {q.r('xf', 8)} AS x_lvl,
          {q.r(f'xf / NULLIF({q.lag("xf", 20)}, 0) - 1')} AS x_roc20, {q.r('px_over_x')} AS px_over_x,
          {q.r(f'px_over_x / NULLIF({q.lag("px_over_x", 20)}, 0) - 1')} AS pxx_roc20,
          {q.r(f'-(xf / NULLIF({q.lag("xf", 20)}, 0) - 1)')} AS inv_roc20 FROM g""",
)
def cross_asset_features(spark: SparkSession, d: str) -> DataFrame:
    """A driver, carried forward over at most five bars without it, and its changes."""
    b = T.bars_li_d(spark, d)
    driver = b.where(F.col("symbol") == "AF").select("ts", F.col("close").alias("x"))
    b = J.asof_fill(b, S, driver, "x", limit=5)
    b = b.withColumn("px_over_x", ratio("close", "x"))
    b = b.withColumns(
        {
            "x_chg5": W.change("x", 5, S),
            "x_lvl": F.col("x"),
            "x_roc20": W.roc("x", 20, S),
            "pxx_roc20": W.roc("px_over_x", 20, S),
            "inv_roc20": -W.roc("x", 20, S),
        }
    )
    return _out(b, _CROSS_OUT, 6)


# which series of the test table stands for which driver; they have days without a bar
_DRIVER_OF = {n: f"U{i}" for i, n in enumerate(J.DRIVERS)}
_XN = [n for n in _DRIVER_OF]
_X_FEATURES = {
    **{f"c_{n}_{k}{d}": (f"x_{n} - {q.lag(f'x_{n}', d)}" if n in J.LEVELS else f"x_{n} / NULLIF({q.lag(f'x_{n}', d)}, 0) - 1")
       for n in _XN for k in (("chg",) if n in J.LEVELS else ("roc",)) for d in (5, 20)},
    **{f"c_{n}_lvl": f"x_{n}" for n in _XN if n in J.LEVELS},
    "c_gold_silver": "close / NULLIF(x_slv, 0)",
    "c_gs_roc20": f"(close / NULLIF(x_slv, 0)) / NULLIF({q.lag('close / NULLIF(x_slv, 0)', 20)}, 0) - 1",
    "c_realyield_proxy": f"-(x_tip / NULLIF({q.lag('x_tip', 20)}, 0) - 1)",
}


@R.add(
    "cross_driver_features",
    f"""WITH b AS ({q.USR_D}),
        w AS (SELECT ts, {', '.join(f"max(CASE WHEN symbol = '{y}' THEN close END) AS r_{n}" for n, y in _DRIVER_OF.items())} FROM b GROUP BY ts),
        f AS (SELECT b.*, {', '.join(f"last_value(r_{n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x_{n}" for n in _XN)}
              FROM b LEFT JOIN w USING (ts))
        SELECT symbol, {q.minute('ts')} AS ts, {', '.join(f'{q.r(e)} AS {c}' for c, e in _X_FEATURES.items())} FROM f""",
)
def cross_driver_features(spark: SparkSession, d: str) -> DataFrame:
    """The cross-asset block from all nine drivers, carried forward at most five bars, for every user's daily bars."""
    b = T.bars_usr_d(spark, d)
    names = F.create_map(*[x for n, y in _DRIVER_OF.items() for x in (F.lit(y), F.lit(n))])
    drivers = b.where(F.col("symbol").isin(*_DRIVER_OF.values())).select(names[F.col("symbol")].alias("symbol"), "ts", "close")
    return _out(J.cross_features(b, S, drivers), list(_X_FEATURES), 6)


@R.add(
    "expanding_percentile_rank",
    f"""WITH b AS ({q.numbered(f'({q.LI_D})')}),
        r AS (SELECT a.symbol, a.ts, a.pos, a.close, count(p.pos) AS n,
                     count(CASE WHEN p.close < a.close THEN 1 END) AS below
              FROM b a LEFT JOIN b p ON p.symbol = a.symbol AND p.pos < a.pos GROUP BY ALL)
        SELECT symbol, {q.minute('ts')} AS ts,
               {q.r('CASE WHEN n >= 250 THEN below / CAST(n AS DOUBLE) END')} AS pct FROM r""",
)
def expanding_percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    b = K.expanding_rank(T.bars_li_d(spark, d), S, "close", "pct", min_obs=250, block_rows=512)
    return _out(b, ["pct"], 6)


@R.add(
    "rolling_percentile_rank",
    f"""WITH b AS ({q.numbered(f'({q.LI_D})')}),
        r AS (SELECT a.symbol, a.ts, a.pos, count(*) AS n,
                     count(CASE WHEN p.close < a.close THEN 1 END) AS below,
                     count(CASE WHEN p.close = a.close THEN 1 END) AS same
              FROM b a JOIN b p ON p.symbol = a.symbol AND p.pos <= a.pos AND p.pos > a.pos - 500 GROUP BY ALL)
        SELECT symbol, {q.minute('ts')} AS ts,
               {q.r('CASE WHEN n >= 100 THEN (below + (same + 1) / 2.0) / n END')} AS pct FROM r""",
)
def rolling_percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    b = K.rolling_rank(T.bars_li_d(spark, d), S, "close", "pct", n=500, min_obs=100, block_rows=1024)
    return _out(b, ["pct"], 6)


@R.add(
    "cross_events",
    f"""WITH b AS ({q.numbered(f'({q.LI_D})')}),
        e AS MATERIALIZED {q.ema_rec('b', {'e12': ('close', span_alpha(12)), 'e26': ('close', span_alpha(26)),
                              'e50': ('close', span_alpha(50)), 'e200': ('close', span_alpha(200))}, macd=True)},
        h AS (SELECT b.symbol, b.ts, e50 > e200 AS above, macd - sig AS hist FROM b JOIN e USING (symbol, pos)),
        f AS (SELECT *, {q.lag('above')} AS was, {q.lag('hist')} AS ph FROM h)
        SELECT symbol, {q.minute('ts')} AS ts, above AND NOT was AS golden, ph < 0 AND hist > 0 AS macd_up,
               ph > 0 AND hist < 0 AS macd_down FROM f
        WHERE (above AND NOT was) OR (ph < 0 AND hist > 0) OR (ph > 0 AND hist < 0)""",
)
def cross_events(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a golden cross or a MACD cross."""
    b = add_ema(
        T.bars_li_d(spark, d),
        S,
        {"e50": ("close", span_alpha(50)), "e200": ("close", span_alpha(200))},
    )
    b = W.add_macd(b, S)
    above, hist = F.col("e50") > F.col("e200"), F.col("macd_hist")
    b = b.withColumns({"_was": W.lagged(above, 1, S), "_ph": W.lagged(hist, 1, S)})
    b = b.withColumns(
        {
            "golden": above & ~F.col("_was"),
            "macd_up": (F.col("_ph") < 0) & (hist > 0),
            "macd_down": (F.col("_ph") > 0) & (hist < 0),
        }
    )
    return b.where("golden OR macd_up OR macd_down").select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "golden", "macd_up", "macd_down"
    )
