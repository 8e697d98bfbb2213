"""SQL twins of the indicator, technical and bearish panels on weekly supplier bars."""

from __future__ import annotations

from ..functions import tables as t
from ..operators.ema import span_alpha
from . import sqlbits as q

_E = {f"ema{n}": ("close", span_alpha(n)) for n in (9, 21, 50, 200)}
_E |= {"e12": ("close", span_alpha(12)), "e26": ("close", span_alpha(26))}


def _sum(x: str, n: int) -> str:
    return f"sum({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _l(x: str, k: int = 1) -> str:
    return q.lag(x, k)


def panel_ctes(src: str = q.LI_W, bench: str = "S1") -> str:
    return f"""
pb AS MATERIALIZED ({q.numbered(f'({src})')}),
pm AS MATERIALIZED ({q.moves('pb')}),
pe AS MATERIALIZED {q.ema_rec('pb', _E, macd=True)},
pj AS (SELECT pm.*, pe.* EXCLUDE (symbol, pos), bb.close AS bclose FROM pm JOIN pe USING (symbol, pos)
       LEFT JOIN (SELECT ts, close FROM pb WHERE symbol = '{bench}') bb ON bb.ts = pm.ts),
pf AS (SELECT *, macd - sig AS hist, last_value(bclose IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS bfill FROM pj),
pa AS (SELECT *, {q.roll('avg', 'gain', 14)} AS ag, {q.roll('avg', 'loss', 14)} AS al,
  {q.roll('avg', 'close', 20)} AS mid20, {q.roll('stddev_samp', 'close', 20)} AS sd20, {q.roll('avg', 'tr', 14)} AS atr_n,
  {q.roll('min', 'low', 14)} AS lo14, {q.roll('max', 'high', 14)} AS hi14,
  {q.roll('avg', 'dm_plus', 14)} AS dp, {q.roll('avg', 'dm_minus', 14)} AS dm, {q.roll('avg', 'volume', 20)} AS av,
  {_sum('dm_plus', 14)} AS dm14_plus, {_sum('dm_minus', 14)} AS dm14_minus,
  coalesce({_sum('CASE WHEN ret < 0 THEN volume END', 20)}, 0) AS dv,
  coalesce({_sum('CASE WHEN ret > 0 THEN volume END', 20)}, 0) AS uv,
  {q.roll('max', 'high', 20)} AS high20,
  max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi52,
  min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS lo52,
  (close / NULLIF({_l('close', 5)}, 0) - 1) * 100 AS r5, (close / NULLIF({_l('close', 20)}, 0) - 1) * 100 AS r20,
  (close / NULLIF({_l('close', 60)}, 0) - 1) * 100 AS roc60, (bfill / NULLIF({_l('bfill', 60)}, 0) - 1) * 100 AS bench_roc60,
  {_l('hist')} AS ph, {_l('ema50')} AS prev_ema50, {_l('ema200')} AS prev_ema200 FROM pf),
pc AS (SELECT *, 100 * (close - lo14) / (hi14 - lo14 + 1e-9) AS k,
  100 * abs(100 * dp / NULLIF(atr_n, 0) - 100 * dm / NULLIF(atr_n, 0))
      / (100 * dp / NULLIF(atr_n, 0) + 100 * dm / NULLIF(atr_n, 0) + 1e-9) AS dx FROM pa),
pd AS (SELECT *, {q.roll('avg', 'k', 3)} AS kd, {q.roll('avg', 'dx', 14)} AS adx_n FROM pc),
pi AS (SELECT *, coalesce(100 - 100 / (1 + ag / NULLIF(al, 0)), 50) AS rsi, hist AS macd_hist, coalesce(ph, 0) AS prev_hist,
  coalesce(mid20 + 2 * sd20, close) AS bb_upper, coalesce(mid20 - 2 * sd20, close) AS bb_lower, coalesce(atr_n, 0) AS atr,
  coalesce(k, 50) AS stoch_k, coalesce(kd, 50) AS stoch_d, coalesce(adx_n, 20) AS adx, coalesce(av, volume) AS avg_volume,
  coalesce(r5, 0) AS roc5, coalesce(r20, 0) AS roc20,
  CASE WHEN pos >= 25 THEN dv / NULLIF(dv + uv, 0) END AS down_share FROM pd)"""


_PAIR = "CASE WHEN {} THEN 1.0 ELSE 0.0 END"


def _pairs(cols, op):
    return "(" + " + ".join(_PAIR.format(f"{a} {op} {b}") for a, b in zip(cols, cols[1:])) + ")"


def _toward(x, cap, per):
    return f"(CASE WHEN ({x}) > 0 THEN 1 ELSE -1 END) * least({cap}, abs({x}) * {per})"


def _macd(side):
    up, better, beyond = (30, ">", ">") if side > 0 else (-30, "<", "<")
    return q.clamp(
        f"50 + CASE WHEN prev_hist < 0 AND macd_hist > 0 THEN {up} WHEN prev_hist > 0 AND macd_hist < 0 THEN {-up} ELSE 0 END"
        f" + CASE WHEN macd_hist {better} prev_hist THEN 15 ELSE -10 END + CASE WHEN macd {beyond} 0 THEN 10 ELSE -10 END",
        0, 100,
    )


def tech_ctes() -> str:
    """Adds `ps`: technical scores from row 30 on."""
    comp = " + ".join(f"s_{k} * {w}" for k, w in t.TECH_WEIGHTS.items())
    stoch = (
        "CASE WHEN stoch_k < 20 AND stoch_k > stoch_d THEN 80 WHEN stoch_k < 20 THEN 65 "
        "WHEN stoch_k > 80 AND stoch_k < stoch_d THEN 20 WHEN stoch_k > 80 THEN 30 ELSE 40 + (50 - stoch_k) * 0.2 END"
    )
    return f"""
pq AS (SELECT *, {q.bands('rsi', *t.RSI)} AS s_rsi, {_macd(1)} AS s_macd,
  CASE WHEN bb_upper - bb_lower < 1e-9 THEN 50 ELSE
    {q.bands('(close - bb_lower) / NULLIF(bb_upper - bb_lower, 0)', *t.BOLLINGER)} END AS s_bb,
  least(100, 20 + {_pairs(['close', 'ema9', 'ema21', 'ema50', 'ema200'], '>')} / 4 * 60
        + CASE WHEN ema50 > ema200 THEN 10 ELSE 0 END) AS s_ema,
  CASE WHEN avg_volume <= 0 THEN 50 ELSE {q.bands('volume / NULLIF(avg_volume, 0)', *t.VOLUME)} END AS s_vol,
  {q.clamp('50 + ' + _toward('roc5', 15, 2) + ' + ' + _toward('roc20', 10, 1), 0, 100)} AS s_mom,
  {q.clamp(stoch, 0, 100)} AS s_stoch, {q.bands('adx', *t.ADX)} AS s_adx FROM pi WHERE pos >= 30),
pr AS (SELECT *, {comp} AS composite, coalesce(atr / NULLIF(close, 0) * 100, 0) AS atr_pct FROM pq),
ps AS (SELECT *, {q.rnd('composite', 2)} AS tech_score,
  (rsi < 35 OR rsi > 70) AND volume > avg_volume * 1.5 AND atr_pct > 0.5 AS scalp,
  composite > 62 AND adx > 20 AND volume > avg_volume * 1.2 AS day,
  composite > 60 AND ema50 > ema200 AND roc20 > 0 AS swing,
  composite > 58 AND ema200 > 0 AND close > ema200 AND adx > 20 AS invest FROM pr)"""


def bear_ctes() -> str:
    """Adds `pz`: bearish scores from row 60 on."""
    comp = " + ".join(f"b_{k} * {w}" for k, w in t.BEAR_WEIGHTS.items())
    return f"""
px AS (SELECT *, least(100, 20 + {_pairs(['close', 'ema21', 'ema50', 'ema200'], '<')} / 3 * 60
        + CASE WHEN ema50 < ema200 THEN 10 ELSE 0 END) AS b_trend,
  coalesce({q.clamp('50 + (bench_roc60 - roc60) * 2', 0, 100)}, 50) AS b_rel,
  {q.clamp('50 + ' + _toward('-roc20', 20, 1.2) + ' + ' + _toward('-roc5', 15, 1.5), 0, 100)} AS b_mom,
  {_macd(-1)} AS b_macd, coalesce({q.clamp('50 + (down_share - 0.5) * 160', 0, 100)}, 50) AS b_dist,
  dm14_minus > dm14_plus AS down_trending,
  coalesce({q.clamp('50 + least(30, (high20 - close) / NULLIF(high20, 0) * 100 * 2) + CASE WHEN close < ema21 THEN 12 ELSE 0 END', 0, 100)}, 50) AS b_rej
  FROM pi WHERE pos >= 60),
py AS (SELECT *, CASE WHEN NOT down_trending THEN 35 ELSE {q.bands('adx', *t.BEAR_ADX)} END AS b_adx FROM px),
pz AS (SELECT *, {q.rnd(comp, 2)} AS bear_score, close * avg_volume AS dollar_volume,
  roc60 - bench_roc60 AS rel_strength FROM py)"""


def texts(*pairs: tuple[str, str]) -> str:
    """Conditional texts joined with ' | ' in order."""
    return "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in pairs) + ")"


def fmt(pattern: str, x: str, scale: str = "") -> str:
    return f"printf('{pattern}', {x})"


TECH_SIGNALS = texts(
    ("rsi < 35", fmt("RSI oversold (%.1f)", "rsi")),
    ("rsi > 65", fmt("RSI overbought (%.1f)", "rsi")),
    ("prev_hist < 0 AND macd_hist > 0", "'MACD bullish crossover'"),
    ("prev_hist > 0 AND macd_hist < 0", "'MACD bearish crossover'"),
    ("close < bb_lower", "'Price below lower Bollinger Band'"),
    ("close > bb_upper", "'Price above upper Bollinger Band'"),
    ("ema50 > ema200 AND prev_ema50 <= prev_ema200", "'Golden Cross (EMA50 crossed above EMA200)'"),
    ("close > ema9 AND ema9 > ema21 AND ema21 > ema50", "'Full EMA bull alignment'"),
    ("volume > avg_volume * 2", fmt("Volume surge (%.1fx avg)", "volume / avg_volume")),
    ("adx > 30", fmt("Strong trend (ADX %.0f)", "adx")),
    ("stoch_k < 20", fmt("Stochastic oversold (%.0f)", "stoch_k")),
    ("roc5 > 3", fmt("5-day momentum +%.1f%%", "roc5")),
)
BEAR_GATES = texts(
    ("rsi < 25", fmt("RSI %.0f — already capitulated, squeeze risk", "rsi")),
    ("dollar_volume < 20000000", fmt("thin: $%.0fM/day — borrow may be hard", "dollar_volume / 1e6")),
    ("close < bb_lower", "'below lower Bollinger — extended, poor entry'"),
    ("ema50 > ema200 AND close > ema50", "'still in an uptrend — this would be shorting strength'"),
    ("rel_strength > 0", fmt("outperforming the benchmark by %.1fpp over 60 bars", "rel_strength")),
)
BEAR_SIGNALS = texts(
    ("close < ema21 AND ema21 < ema50 AND ema50 < ema200", "'Full EMA bear alignment'"),
    ("ema50 < ema200", "'Death-cross structure (EMA50 < EMA200)'"),
    ("prev_hist > 0 AND macd_hist < 0", "'MACD bearish crossover'"),
    ("roc20 < -5", fmt("20-day momentum %.1f%%", "roc20")),
    ("rel_strength < -5", fmt("Lagging the benchmark by %.1fpp over 60 bars", "-rel_strength")),
    ("b_dist > 62", "'Distribution: down days carry the volume'"),
    ("adx > 30 AND down_trending", fmt("Strong downtrend (ADX %.0f)", "adx")),
    ("rsi > 60", fmt("RSI %.0f — bounce into resistance", "rsi")),
    ("close > ema200", "'Above EMA200 — counter-trend short'"),
)
