"""Sessions, hour rules, event studies, stop selection and intraday grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.num import shown
from ..operators import events as E
from ..operators import exits as X
from ..operators import rolling as W
from ..operators import sessions as N
from ..operators.ema import add_ema, span_alpha, wilder_alpha
from ..operators.series import plain
from ..operators.settle import settle
from ..plans import research as P
from ..sources import tables as T
from . import sqlbits as q
from .indicators import STRUCT_CTES, STRUCT_FLAGS
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins
S = plain()
SPREAD = t.SPREAD_MEDIAN
# the given events lie in January, when New York is five hours behind UTC all month
_ET = "ts - INTERVAL 5 HOUR"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return N.add_clock(T.bars_evt_h(spark, d))


_H = f"""
hb AS (SELECT *, {_ET} AS ts_et, CAST(hour({_ET}) AS INTEGER) AS hour, CAST(isodow({_ET}) - 1 AS INTEGER) AS dow,
       CAST({_ET} - INTERVAL 18 HOUR AS DATE) AS session_date, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM ({q.EVT_H})),
hm AS MATERIALIZED ({q.moves('hb')})"""
_HATR = f"ha AS MATERIALIZED {q.ema_rec('hm', {'atr': ('tr', wilder_alpha(24))})}"


@R.add(
    "volatility_by_hour",
    f"""WITH {_H}, {_HATR}, j AS (SELECT hm.*, atr FROM hm JOIN ha USING (symbol, pos)),
        o AS (SELECT symbol, stddev_samp(ret) AS s FROM j GROUP BY symbol)
        SELECT symbol, hour, {q.r('stddev_samp(ret)')} AS sigma, count(ret) AS n, {q.r('stddev_samp(ret) / any_value(s)', 5)} AS x,
               {q.r('quantile_cont(atr, 0.5)')} AS median_atr FROM j JOIN o USING (symbol) GROUP BY symbol, hour""",
)
def volatility_by_hour(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d).withColumns({"ret": W.roc("close", 1, S), "_tr": W.true_range(S)})
    b = add_ema(b, S, {"atr": ("_tr", wilder_alpha(24))})
    p = N.volatility_by_hour(b)
    return p.select(
        "symbol", "hour", shown("sigma").alias("sigma"), "n", shown("x", 5).alias("x"),
        shown("median_atr").alias("median_atr"),
    )


@R.add(
    "session_averages",
    f"""WITH {_H}, o AS (SELECT symbol, stddev_samp(ret) AS s FROM hm GROUP BY symbol),
        p AS (SELECT symbol, hour, stddev_samp(ret) / any_value(s) AS x FROM hm JOIN o USING (symbol) GROUP BY symbol, hour),
        s AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {h})" for n, hs in t.SESSIONS for h in hs)}) AS s(session, hour))
        SELECT symbol, session, {q.r('avg(x)', 5)} AS mean_x, count(*) AS hours FROM p JOIN s USING (hour) GROUP BY symbol, session""",
)
def session_averages(spark: SparkSession, d: str) -> DataFrame:
    b = hourly(spark, d).withColumns({"ret": W.roc("close", 1, S), "atr": F.lit(None).cast("double")})
    names = spark.createDataFrame([(n, h) for n, hs in t.SESSIONS for h in hs], "session string, hour int")
    out = N.session_averages(N.volatility_by_hour(b), names)
    return out.withColumn("mean_x", shown("mean_x", 5))


@R.add(
    "return_by_hour",
    f"""WITH {_H}, f AS (SELECT *, {q.lead('close')} / NULLIF(close, 0) - 1 AS fwd1 FROM hm),
        g AS (SELECT symbol, hour, count(fwd1) AS n, avg(fwd1) AS mean, avg(fwd1) / (stddev_samp(fwd1) / sqrt(count(fwd1))) AS t,
              avg(CASE WHEN fwd1 > 0 THEN 1.0 WHEN fwd1 IS NOT NULL THEN 0.0 END) AS hit FROM f GROUP BY symbol, hour HAVING count(fwd1) >= 20)
        SELECT symbol, hour, n, {q.r('mean')} AS mean, {q.r('t', 4)} AS t, {q.r('hit')} AS hit,
               CAST(row_number() OVER (PARTITION BY symbol ORDER BY abs(t) DESC, hour) AS INTEGER) AS rank_t,
               CAST(row_number() OVER (PARTITION BY symbol ORDER BY mean DESC, hour) AS INTEGER) AS rank_mean FROM g""",
)
def return_by_hour(spark: SparkSession, d: str) -> DataFrame:
    b = W.add_forward_returns(hourly(spark, d), S, (1,))
    out = N.result_by_hour(b, "fwd1", min_n=20)
    return out.withColumns({"mean": shown("mean"), "t": shown("t", 4), "hit": shown("hit")})


@R.add(
    "multiple_comparisons",
    f"""WITH {_H}, f AS (SELECT *, {q.lead('close')} / NULLIF(close, 0) - 1 AS fwd1 FROM hm),
        g AS (SELECT symbol, hour, avg(fwd1) / (stddev_samp(fwd1) / sqrt(count(fwd1))) AS t FROM f GROUP BY symbol, hour HAVING count(fwd1) >= 20)
        SELECT count(*) AS tests, CAST(count(*) FILTER (abs(t) > 1.96) AS BIGINT) AS raw_hits, {q.r('count(*) * 0.05')} AS expected_hits,
               {q.r('0.05 / greatest(count(*), 1)', 8)} AS bonferroni_p FROM g""",
)
def multiple_comparisons(spark: SparkSession, d: str) -> DataFrame:
    b = W.add_forward_returns(hourly(spark, d), S, (1,))
    out = E.multiple_tests(N.result_by_hour(b, "fwd1", min_n=20), "t")
    return out.withColumns({"expected_hits": shown("expected_hits"), "bonferroni_p": shown("bonferroni_p", 8)})


@R.add("bonferroni_survivors")
def bonferroni_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Hours whose mean return passes the corrected threshold (p-values: rows only)."""
    b = W.add_forward_returns(hourly(spark, d), S, (1,))
    return E.survivors(N.result_by_hour(b, "fwd1", min_n=20), "t", "n")


@R.add(
    "market_calendar",
    f"""WITH e AS (SELECT DISTINCT {_ET} AS ts_et FROM events), h AS (SELECT ts_et, isodow(ts_et) - 1 AS dow, hour(ts_et) AS hr FROM e),
        s AS (SELECT *, CASE WHEN dow = 4 AND hr >= 17 THEN 'weekend break since Friday' WHEN dow = 5 THEN 'weekend break'
              WHEN dow = 6 AND hr < 18 THEN 'weekend break, reopens today' WHEN hr = 17 THEN 'daily halt' ELSE '' END AS reason,
              CASE WHEN dow = 4 AND hr >= 17 THEN 2 WHEN dow = 5 THEN 1 ELSE 0 END AS days FROM h)
        SELECT reason, reason = '' AS market_open, count(*) AS n,
               {q.minute("min(CASE WHEN reason <> '' THEN date_trunc('day', ts_et) + to_days(CAST(days AS INTEGER)) + INTERVAL 18 HOUR END)")} AS first_reopen
        FROM s GROUP BY reason""",
)
def market_calendar(spark: SparkSession, d: str) -> DataFrame:
    e = N.market_status(N.add_clock(T.table(spark, d, "events").select("ts").distinct()))
    return e.groupBy("reason", "market_open").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.min("reopens"), "yyyy-MM-dd HH:mm").alias("first_reopen")
    )


def _trades_sql(hour: int, last_dow: int = 6) -> str:
    return f"""tr AS (SELECT symbol, ts, dow, x AS exit, close AS entry, x - close AS gross, x - close - {SPREAD} AS net, xo - close AS gap, x - xo AS bar,
        epoch(xt - ts) / 3600.0 AS hold_h FROM (SELECT *, {q.lead('close')} AS x, {q.lead('ts')} AS xt, {q.lead('open')} AS xo FROM hb)
        WHERE hour = {hour} AND dow <= {last_dow} AND x IS NOT NULL)"""


_TR = ["entry", "exit", "gross", "net", "gap", "bar", "hold_h"]


@R.add(
    "hour_rule_trades",
    f"WITH {_H}, {_trades_sql(16)} SELECT symbol, {q.minute('ts')} AS ts, dow, {', '.join(f'{q.r(c)} AS {c}' for c in _TR)}, net > 0 AS win FROM tr",
)
def hour_rule_trades(spark: SparkSession, d: str) -> DataFrame:
    x = N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD))
    return x.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "dow", *[shown(c).alias(c) for c in _TR], "win"
    )


def _record_sql(by: str) -> str:
    w = f"PARTITION BY {by} ORDER BY ts"
    return f"""e AS (SELECT *, sum(net) OVER ({w}) AS equity, sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) OVER ({w}) AS wins FROM tr),
      p AS (SELECT *, equity - greatest(0, max(equity) OVER ({w})) AS dd,
            sum(CASE WHEN net > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {by}, wins ORDER BY ts) AS run FROM e)
      SELECT {by}, count(*) AS n, {q.r('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS win, {q.r('avg(net)')} AS mean, {q.r('sum(net)')} AS total,
        {q.r('sum(CASE WHEN net > 0 THEN net END) / NULLIF(-sum(CASE WHEN net < 0 THEN net END), 0)')} AS pf, {q.r('min(net)')} AS worst,
        {q.r('max(net)')} AS best, {q.r('min(dd)')} AS max_dd, CAST(max(run) AS BIGINT) AS streak,
        {q.r('avg(net) / NULLIF(stddev_samp(net) / sqrt(count(*)), 0)', 4)} AS t, {q.r('sum(net) / NULLIF(-min(dd), 0)', 4)} AS calmar FROM p GROUP BY {by}"""


_REC = ["win", "mean", "total", "pf", "worst", "best", "max_dd"]


def _record_out(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(
        *by, "n", *[shown(c).alias(c) for c in _REC], "streak", shown("t", 4).alias("t"), shown("calmar", 4).alias("calmar")
    )


@R.add("hour_rule_record", f"WITH {_H}, {_trades_sql(16)}, {_record_sql('symbol')}")
def hour_rule_record(spark: SparkSession, d: str) -> DataFrame:
    x = N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD))
    return _record_out(N.record(x, S, ["symbol"]), ["symbol"])


@R.add(
    "weekly_hour_record",
    f"WITH {_H}, {_trades_sql(16).replace('SELECT symbol, ts, dow', 'SELECT symbol, ts, CAST(isoyear(ts) AS INTEGER) AS year, CAST(week(ts) AS INTEGER) AS week, dow')}, {_record_sql('symbol, year, week')}",
)
def weekly_hour_record(spark: SparkSession, d: str) -> DataFrame:
    x = N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD))
    x = x.withColumns({"year": F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("int"), "week": F.weekofyear("ts")})
    return _record_out(N.record(x, S, ["symbol", "year", "week"]), ["symbol", "year", "week"])


_HOLDOUT = 14


@R.add(
    "hour_rule_periods",
    f"""WITH {_H}, {_trades_sql(16).replace('tr AS (', 'ta AS (', 1)}, tl AS (SELECT *, max(ts) OVER () AS lt FROM ta),
        tr AS (SELECT *, 'full' AS period FROM tl UNION ALL SELECT *, CASE WHEN ts <= lt - INTERVAL {_HOLDOUT} DAY THEN 'train' ELSE 'holdout' END FROM tl
               UNION ALL SELECT *, CAST(year(ts) AS VARCHAR) FROM tl), {_record_sql('symbol, period')}""",
)
def hour_rule_periods(spark: SparkSession, d: str) -> DataFrame:
    """The record of the hour rule for the full period, before and in the holdout (the last days), and per year."""
    x = N.by_period(N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD)), f"INTERVAL {_HOLDOUT} DAYS")
    return _record_out(N.record(x, S, ["symbol", "period"]), ["symbol", "period"])


@R.add(
    "paper_record",
    f"WITH {_H}, {_trades_sql(16, 3)}, {_record_sql('symbol').replace('FROM tr)', 'FROM tr WHERE ts >= TIMESTAMP ' + chr(39) + '2024-01-08' + chr(39) + ')', 1)}",
)
def paper_record(spark: SparkSession, d: str) -> DataFrame:
    """The rule replayed since a start date, Monday to Thursday only."""
    x = N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD), last_dow=3).where(F.col("ts") >= "2024-01-08")
    return _record_out(N.record(x, S, ["symbol"]), ["symbol"])


_OV = [f"{x}_{y}" for x in ("gap", "bar", "total_net") for y in ("mean", "t", "hit")]


@R.add(
    "overnight_decomposition",
    f"""WITH {_H}, {_trades_sql(16)}, x AS (SELECT *, gross - 0.20 AS total_net, dow = 4 AS friday FROM tr)
        SELECT symbol, CASE WHEN friday IS NULL THEN 'all' WHEN friday THEN 'friday' ELSE 'other' END AS days, count(*) AS n,
          {q.r('quantile_cont(hold_h, 0.5)')} AS median_hold,
          {', '.join(f"{q.r(f'avg({c})')} AS {c}_mean, {q.r(f'avg({c}) / NULLIF(stddev_samp({c}) / sqrt(count(*)), 0)', 4)} AS {c}_t, {q.r(f'avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END)')} AS {c}_hit" for c in ('gap', 'bar', 'total_net'))},
          {q.r('min(total_net)')} AS worst, {q.r('quantile_cont(total_net, 0.05)')} AS p05, {q.r('stddev_pop(total_net)')} AS sd
        FROM x GROUP BY GROUPING SETS ((symbol), (symbol, friday))""",
)
def overnight_decomposition(spark: SparkSession, d: str) -> DataFrame:
    o = N.overnight_split(N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD)), cost=0.20)
    return o.select(
        "symbol", "days", "n", *[shown(c, 4 if c.endswith("_t") else 6).alias(c) for c in ["median_hold", *_OV, "worst", "p05", "sd"]]
    )


@R.add(
    "loss_concentration",
    f"""WITH {_H}, {_trades_sql(16)}, x AS (SELECT *, gross - 0.20 AS total_net, row_number() OVER (PARTITION BY symbol ORDER BY gross - 0.20, ts) AS rn FROM tr)
        SELECT symbol, CAST(count(*) FILTER (dow = 4) AS BIGINT) AS fridays, {q.r('avg(abs(gap) / NULLIF(abs(gap) + abs(bar), 0))')} AS gap_share,
               {q.r('min(total_net)')} AS worst FROM x WHERE rn <= 10 GROUP BY symbol""",
)
def loss_concentration(spark: SparkSession, d: str) -> DataFrame:
    c = N.loss_concentration(N.hour_trades(hourly(spark, d), S, 16, F.lit(SPREAD)), cost=0.20)
    return c.withColumns({"gap_share": shown("gap_share"), "worst": shown("worst")})


@R.add(
    "all_hours_control",
    f"""WITH {_H}, f AS (SELECT symbol, hour, ts, {q.lead('close')} - close - {SPREAD} AS net FROM hb),
        g AS (SELECT symbol, hour, count(net) AS n, avg(net) AS mean, avg(net) / (stddev_samp(net) / sqrt(count(net))) AS t,
              avg(CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0.0 END) AS hit FROM f GROUP BY symbol, hour HAVING count(net) >= 10),
        s AS (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM f),
        a AS (SELECT symbol, hour, avg(net) AS m0, avg(net) / (stddev_samp(net) / sqrt(count(net))) AS t0 FROM f, s WHERE ts <= cut GROUP BY ALL HAVING count(net) >= 5),
        b AS (SELECT symbol, hour, avg(net) AS m1, avg(net) / (stddev_samp(net) / sqrt(count(net))) AS t1 FROM f, s WHERE ts > cut GROUP BY ALL HAVING count(net) >= 5)
        SELECT g.symbol, g.hour, n, {q.r('mean')} AS mean, {q.r('t', 4)} AS t, CAST(row_number() OVER (PARTITION BY g.symbol ORDER BY mean DESC, g.hour) AS INTEGER) AS rank_mean,
          {q.r('m0')} AS train_mean, {q.r('m1')} AS holdout_mean, sign(m0) = sign(m1) AS sign_held,
          CASE WHEN sign(m0) = sign(m1) AND m1 > 0 AND abs(t1) > 1.96 THEN 'survives' WHEN sign(m0) = sign(m1) AND m1 > 0 THEN 'same direction' ELSE 'fails' END AS verdict
        FROM g JOIN a ON a.symbol = g.symbol AND a.hour = g.hour JOIN b ON b.symbol = g.symbol AND b.hour = g.hour""",
)
def all_hours_control(spark: SparkSession, d: str) -> DataFrame:
    """Every hour under the same rule, ranked, with the sign of train and holdout compared."""
    b = hourly(spark, d)
    b = b.withColumn("net", W.ahead("close", 1, S) - F.col("close") - SPREAD)
    cut = b.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("_cut"))
    b = b.crossJoin(F.broadcast(cut))
    whole = N.result_by_hour(b, "net", 10)
    early = N.result_by_hour(b.where(F.col("ts") <= F.col("_cut")), "net", 5)
    late = N.result_by_hour(b.where(F.col("ts") > F.col("_cut")), "net", 5)
    sign = P.sign_stability(early, late, ["symbol", "hour"])
    return whole.join(sign, ["symbol", "hour"]).select(
        "symbol", "hour", "n", shown("mean").alias("mean"), shown("t", 4).alias("t"), "rank_mean",
        shown("train_mean").alias("train_mean"), shown("holdout_mean").alias("holdout_mean"), "sign_held", "verdict",
    )


_BREAK = f"""
rg AS (SELECT symbol, session_date, max(high) AS r_high, min(low) AS r_low FROM hb WHERE hour >= 19 OR hour <= 2 GROUP BY ALL HAVING count(*) >= 5),
br AS (SELECT hb.*, CASE WHEN close > r_high THEN 1 WHEN close < r_low THEN -1 END AS dirn FROM hb JOIN rg USING (symbol, session_date) WHERE hour BETWEEN 3 AND 16),
bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session_date, dirn ORDER BY ts) AS rn FROM br WHERE dirn IS NOT NULL) WHERE rn = 1)"""


@R.add(
    "session_breakouts",
    f"WITH {_H}, {_BREAK} SELECT symbol, {q.minute('ts')} AS ts, {q.day('session_date')} AS session_date, dirn, {q.r('close', 8)} AS close FROM bf",
)
def session_breakouts(spark: SparkSession, d: str) -> DataFrame:
    """First close outside the overnight range per session day and direction."""
    b = N.first_breaks(N.session_range(hourly(spark, d), 19, 2, 5), 3, 16)
    return b.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), F.date_format("session_date", "yyyy-MM-dd").alias("session_date"),
        "dirn", shown("close", 8).alias("close"),
    )


def _touch_sql(entries: str, bars: str, n: int, k: str, rr: str, entry: str = "close", extra: str = "") -> str:
    """entries: symbol, pos, dirn, close, atr.  -> r (before costs), per entry."""
    keys = f"e.symbol, e.pos, e.dirn, e.close, e.atr{extra}"
    return f"""(SELECT {keys.replace('e.', '')}, CASE WHEN min(hitpos) IS NOT NULL THEN arg_min(res, hitpos)
          ELSE dirn * (arg_max(c, bpos) - close) / ({k} * atr) END AS r,
          coalesce(min(hitpos) - pos, max(bpos) - pos) AS bars FROM (
        SELECT {keys}, b.close AS c, b.pos AS bpos,
          CASE WHEN CASE WHEN e.dirn > 0 THEN b.low <= e.close - e.dirn * {k} * e.atr ELSE b.high >= e.close - e.dirn * {k} * e.atr END THEN -1.0::DOUBLE
               WHEN CASE WHEN e.dirn > 0 THEN b.high >= e.close + e.dirn * {k} * e.atr * {rr} ELSE b.low <= e.close + e.dirn * {k} * e.atr * {rr} END THEN CAST({rr} AS DOUBLE) END AS res,
          CASE WHEN res IS NOT NULL THEN b.pos END AS hitpos
        FROM {entries} e JOIN {bars} b ON b.symbol = e.symbol AND b.pos > e.pos AND b.pos <= e.pos + {n} WHERE e.atr > 0)
        GROUP BY {keys.replace('e.', '')})"""


@R.add(
    "breakout_trades",
    f"""WITH {_H}, {_HATR}, {_BREAK}, en AS (SELECT bf.symbol, bf.pos, bf.dirn, bf.close, atr FROM bf JOIN ha USING (symbol, pos)),
        o AS (SELECT *, r - 2 * 0.05 / 1.5 AS rc FROM {_touch_sql('en', 'hb', 12, '1.5', '2.0')})
        SELECT symbol, dirn, count(*) AS n, {q.r('avg(CASE WHEN rc > 0 THEN 1.0 ELSE 0.0 END)')} AS win, {q.r('avg(rc)')} AS mean_r,
               {q.r('sum(CASE WHEN rc > 0 THEN rc END) / NULLIF(-sum(CASE WHEN rc < 0 THEN rc END), 0)')} AS pf, {q.r('avg(bars)')} AS mean_bars
        FROM o GROUP BY symbol, dirn""",
)
def breakout_trades(spark: SparkSession, d: str) -> DataFrame:
    """Session breakouts with a 1.5 ATR stop, 2R target, twelve bars at most."""
    b = hourly(spark, d).withColumn("_tr", W.true_range(S))
    b = E.path_ahead(add_ema(b, S, {"atr": ("_tr", wilder_alpha(24))}), S, 12)
    b = N.first_breaks(N.session_range(b, 19, 2, 5), 3, 16)
    r, bars = E.first_touch(F.col("dirn"), F.col("close"), 1.5 * F.col("atr"), F.lit(2.0))
    b = b.withColumns({"r": r - F.lit(2 * 0.05 / 1.5), "bars": bars})
    out = E.trade_summary(b, ["symbol", "dirn"]).join(b.groupBy("symbol", "dirn").agg(F.avg("bars").alias("mb")), ["symbol", "dirn"])
    return out.select(
        "symbol", "dirn", "n", shown("win").alias("win"), shown("mean_r").alias("mean_r"), shown("pf").alias("pf"), shown("mb").alias("mean_bars")
    )


_ZONES = ", ".join(f"('{n}', {h})" for n, h in t.KILL_ZONES)


def both_ways_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Long and short entries at every hourly bar: 1.5 ATR stop, 2R target, twelve bars at most, fifteen bars after the entry."""
    b = hourly(spark, d).withColumn("_tr", W.true_range(S))
    return E.both_ways(add_ema(b, S, {"atr": ("_tr", wilder_alpha(24))}), S, 12, 1.5, 2.0, 0.05, 15)


@R.add(
    "kill_zone_trades",
    f"""WITH {_H}, {_HATR}, z AS (SELECT * FROM (VALUES {_ZONES}) AS z(zone, h0)), x AS (SELECT symbol, max(pos) AS n FROM hb GROUP BY symbol),
        en AS (SELECT hb.symbol, hb.pos, w.dirn, hb.close, atr, zone FROM hb JOIN ha USING (symbol, pos) JOIN z ON hour = h0
               JOIN x ON x.symbol = hb.symbol AND hb.pos <= n - 15, (VALUES (1), (-1)) AS w(dirn)),
        o AS (SELECT *, r - 2 * 0.05 / 1.5 AS rc FROM {_touch_sql('en', 'hb', 12, '1.5', '2.0', extra=', e.zone')})
        SELECT symbol, zone, dirn, count(*) AS n, {q.r('avg(CASE WHEN rc > 0 THEN 1.0 ELSE 0.0 END)')} AS win, {q.r('avg(rc)')} AS mean_r,
               {q.r('sum(CASE WHEN rc > 0 THEN rc END) / NULLIF(-sum(CASE WHEN rc < 0 THEN rc END), 0)')} AS pf
        FROM o GROUP BY symbol, zone, dirn HAVING count(*) >= 20""",
)
def kill_zone_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades in both directions at the opening hours of the kill zones, where there are twenty or more."""
    x = N.zone_trades(both_ways_hourly(spark, d), t.KILL_ZONES)
    out = E.trade_summary(x, ["symbol", "zone", "dirn"]).where(F.col("n") >= 20)
    return out.select("symbol", "zone", "dirn", "n", shown("win").alias("win"), shown("mean_r").alias("mean_r"), shown("pf").alias("pf"))


@R.add("kill_zone_control")
def kill_zone_control(spark: SparkSession, d: str) -> DataFrame:
    """The same trades against 400 random draws of as many bars of the symbol, traded alike (rows only)."""
    pool = settle(both_ways_hourly(spark, d).select("symbol", "ts", "hour", "dirn", "r"))
    return N.zone_control(pool, t.KILL_ZONES, reps=400, seed=23, least=20)


# ── long daily series ────────────────────────────────────────────────────────
_D = f"db AS MATERIALIZED ({q.numbered(f'({q.LI_D})')}), dm AS MATERIALIZED ({q.moves('db')})"
_DATR = f"da AS MATERIALIZED {q.ema_rec('dm', {'atr': ('tr', wilder_alpha(14))})}"


@R.add(
    "first_touch_results",
    f"""WITH {_D}, {_DATR}, en AS (SELECT db.symbol, db.pos, db.close, atr, x.dirn FROM db JOIN da USING (symbol, pos), (VALUES (1), (-1)) AS x(dirn))
        SELECT symbol, pos - 1 AS pos, dirn, {q.r('r - 2 * 0.05 / 1.5')} AS r, CAST(bars AS INTEGER) AS bars FROM {_touch_sql('en', 'db', 20, '1.5', '2.0')}""",
)
def first_touch_results(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of a long and a short entry at every daily bar."""
    b = T.bars_li_d(spark, d).withColumn("_tr", W.true_range(S))
    b = E.numbered(E.path_ahead(add_ema(b, S, {"atr": ("_tr", wilder_alpha(14))}), S, 20), S)
    b = b.withColumn("dirn", F.explode(F.array(F.lit(1), F.lit(-1))))
    r, bars = E.first_touch(F.col("dirn"), F.col("close"), 1.5 * F.col("atr"), F.lit(2.0))
    b = b.withColumns({"r": r - F.lit(2 * 0.05 / 1.5), "bars": bars}).where(F.col("r").isNotNull())
    return b.select("symbol", F.col("pos").cast("long").alias("pos"), "dirn", shown("r").alias("r"), "bars")


_GRID = ((1, 2.0), (-1, 2.0), (1, 5.0), (-1, 5.0))


@R.add(
    "long_horizon_exits",
    f"""WITH {_D}, {_DATR}, en AS (SELECT db.symbol, db.pos, db.close, atr, x.dirn, x.rr FROM db JOIN da USING (symbol, pos),
          (VALUES {', '.join(f'({d}, CAST({x} AS DOUBLE))' for d, x in _GRID)}) AS x(dirn, rr)),
        o AS (SELECT * FROM {_touch_sql('en', 'db', 250, '6.0', 'e.rr', extra=', e.rr')})
        SELECT symbol, dirn, {q.r('rr', 2)} AS rr, count(*) AS n, {q.r('avg(r)')} AS mean_r, {q.r('avg(bars)')} AS mean_bars, max(bars) AS longest FROM o GROUP BY symbol, dirn, rr""",
)
def long_horizon_exits(spark: SparkSession, d: str) -> DataFrame:
    """Trades held for up to 250 bars behind a stop of six ATR: results and how long they take."""
    b = add_ema(T.bars_li_d(spark, d).withColumn("_tr", W.true_range(S)), S, {"atr": ("_tr", wilder_alpha(14))})
    trades = F.array(*[
        F.struct(F.lit(dirn).alias("dirn"), F.col("close").alias("entry"), (6.0 * F.col("atr")).alias("risk"), F.lit(rr).alias("rr")) for dirn, rr in _GRID
    ])
    out = X.first_touch_exits(b.select("symbol", "ts", "high", "low", "close", "atr"), S, trades, 250)
    kinds = F.array(*[F.struct(F.lit(dirn).alias("dirn"), F.lit(rr).alias("rr")) for dirn, rr in _GRID])
    each = out.withColumn("kind", kinds).select("symbol", F.explode(F.arrays_zip("kind", "exits")).alias("_e"))
    each = each.select("symbol", "_e.kind.*", "_e.exits.*").where("r is not null")
    means = each.groupBy("symbol", "dirn", "rr").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.avg("bars").alias("mb"), F.max("bars").cast("long").alias("longest"))
    return means.select("symbol", "dirn", shown("rr", 2).alias("rr"), "n", shown("m").alias("mean_r"), shown("mb").alias("mean_bars"), "longest")


@R.add(
    "target_sweep",
    f"""WITH {_D}, {_DATR}, fv AS (SELECT *, {q.lag('high', 2)} AS h2 FROM db),
        en AS (SELECT fv.symbol, fv.pos, 1 AS dirn, close, atr, rr FROM fv JOIN da USING (symbol, pos), (VALUES (0.25), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0)) AS g(rr) WHERE low > h2),
        o AS (SELECT *, r - 2 * 0.05 / 1.5 AS rc FROM {_touch_sql('en', 'db', 20, '1.5', 'e.rr', extra=', e.rr')})
        SELECT symbol, {q.r('rr', 2)} AS rr, count(*) AS n, {q.r('avg(CASE WHEN rc > 0 THEN 1.0 ELSE 0.0 END)')} AS win, {q.r('avg(rc)')} AS mean_r, {q.r('sum(rc)', 4)} AS total_r FROM o GROUP BY symbol, rr""",
)
def target_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Win rate against reward:risk for gap-up entries, one path per entry for the whole grid."""
    b = T.bars_li_d(spark, d).withColumns({"_tr": W.true_range(S), "_h2": W.lagged("high", 2, S)})
    b = E.path_ahead(add_ema(b, S, {"atr": ("_tr", wilder_alpha(14))}), S, 20).where(F.col("low") > F.col("_h2"))
    grid = F.explode(F.array(*[F.lit(float(x)) for x in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)]))
    b = b.withColumn("rr", grid)
    r, _ = E.first_touch(F.lit(1), F.col("close"), 1.5 * F.col("atr"), F.col("rr"))
    b = b.withColumn("r", r - F.lit(2 * 0.05 / 1.5)).where(F.col("r").isNotNull())
    out = E.trade_summary(b, ["symbol", "rr"])
    return out.select(
        "symbol", shown("rr", 2).alias("rr"), "n", shown("win").alias("win"), shown("mean_r").alias("mean_r"), shown("total_r", 4).alias("total_r")
    )


_SETUP_SQL = f"""
WITH RECURSIVE b AS ({q.numbered(f'({q.LI_D})')}),
f AS MATERIALIZED (SELECT symbol, pos - 1 AS pos, low > {q.lag('high', 2)} AS up, high < {q.lag('low', 2)} AS dn,
      high < {q.lag('high')} AND low > {q.lag('low')} AS ins, {q.lead('close', 10)} / NULLIF(close, 0) - 1 AS fwd FROM b),
l AS MATERIALIZED (SELECT symbol, pos, fwd, s AS setup, CASE WHEN v THEN 1.0 ELSE 0.0 END AS hit, d AS dirn FROM
      (SELECT symbol, pos, fwd, 'fvg_up' AS s, up AS v, 1 AS d FROM f UNION ALL SELECT symbol, pos, fwd, 'fvg_dn', dn, -1 FROM f
       UNION ALL SELECT symbol, pos, fwd, 'inside_bar', ins, 1 FROM f) WHERE fwd IS NOT NULL),
nx AS MATERIALIZED (SELECT a.symbol, a.setup, a.hit, a.pos, min(c.pos) AS nxt FROM l a JOIN l c ON c.symbol = a.symbol AND c.setup = a.setup AND c.hit = a.hit
       AND c.pos >= a.pos + 10 AND c.pos < a.pos + 400 GROUP BY ALL),
k AS (SELECT symbol, setup, hit, min(pos) AS pos FROM l GROUP BY ALL
      UNION ALL SELECT k.symbol, k.setup, k.hit, nx.nxt FROM k JOIN nx USING (symbol, setup, hit, pos)),
x AS (SELECT l.symbol, l.setup, l.hit, l.dirn * l.fwd AS v FROM k JOIN l USING (symbol, setup, hit, pos)),
g AS (SELECT symbol, setup, count(v) FILTER (hit = 1) AS n, avg(v) FILTER (hit = 1) AS ma, avg(v) FILTER (hit = 0) AS mb,
      var_samp(v) FILTER (hit = 1) / count(v) FILTER (hit = 1) AS va, var_samp(v) FILTER (hit = 0) / count(v) FILTER (hit = 0) AS vb FROM x GROUP BY ALL)
SELECT symbol, setup, CAST(n AS BIGINT) AS n, {q.r('ma')} AS event_mean, {q.r('mb')} AS base_mean, {q.r('(ma - mb) / sqrt(va + vb)', 4)} AS t FROM g WHERE n >= 12"""


@R.add("event_study", _SETUP_SQL)
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Directional edge of gap and inside-bar setups at ten bars, de-overlapped, Welch test."""
    b = E.numbered(W.add_forward_returns(W.add_structure(T.bars_li_d(spark, d), S), S, (10,)), S)
    keep = {k: E.SETUPS[k] for k in ("fvg_up", "fvg_dn", "inside_bar")}
    rows = E.setup_rows(b.where(F.col("fwd10").isNotNull()), ["symbol", "pos", "fwd10"], keep)
    kept = E.de_overlap(rows, ["symbol", "setup", "hit"], 10)
    x = F.col("dirn") * F.col("fwd10")
    a, base = F.when(F.col("hit") == 1, x), F.when(F.col("hit") == 0, x)
    from ..functions import stats as st

    tv, _ = st.welch(a, base)
    out = kept.groupBy("symbol", "setup").agg(
        F.count(a).alias("n"), F.avg(a).alias("ma"), F.avg(base).alias("mb"), tv.alias("tv")
    )
    return out.where(F.col("n") >= 12).select(
        "symbol", "setup", "n", shown("ma").alias("event_mean"), shown("mb").alias("base_mean"), shown("tv", 4).alias("t")
    )


_EDGE_KEYS = "symbol, setup, hit, h"
_STUDY_SQL = f"""
{STRUCT_CTES.replace('WITH b', 'WITH RECURSIVE b', 1)},
f AS MATERIALIZED (SELECT symbol, pos, {STRUCT_FLAGS}, {', '.join(f"{q.lead('close', h)} / NULLIF(close, 0) - 1 AS fwd{h}" for h in (5, 10, 20))} FROM v),
le AS MATERIALIZED ({' UNION ALL '.join(
    f"SELECT symbol, pos, '{n}' AS setup, {c} AS hit, {d} AS dirn, {h} AS h, fwd{h} AS fwd FROM f WHERE fwd{h} IS NOT NULL"
    for n, (c, d) in E.SETUPS.items() for h in (5, 10, 20))}),
nx AS MATERIALIZED (SELECT a.symbol, a.setup, a.hit, a.h, a.pos, c.pos AS nxt FROM (SELECT *, pos + h AS at_least FROM le) a
      ASOF JOIN le c ON c.symbol = a.symbol AND c.setup = a.setup AND c.hit = a.hit AND c.h = a.h AND a.at_least <= c.pos),
k AS (SELECT {_EDGE_KEYS}, min(pos) AS pos FROM le GROUP BY ALL
      UNION ALL SELECT k.symbol, k.setup, k.hit, k.h, nx.nxt FROM k JOIN nx USING ({_EDGE_KEYS}, pos)),
x AS (SELECT {_EDGE_KEYS}, le.dirn * le.fwd AS v FROM k JOIN le USING ({_EDGE_KEYS}, pos)),
g AS (SELECT symbol, setup, h, count(v) FILTER (hit = 1) AS n, avg(v) FILTER (hit = 1) AS ma, avg(v) FILTER (hit = 0) AS mb,
      var_samp(v) FILTER (hit = 1) / count(v) FILTER (hit = 1) AS va, var_samp(v) FILTER (hit = 0) / count(v) FILTER (hit = 0) AS vb,
      count(v) FILTER (hit = 0) AS n0 FROM x GROUP BY symbol, setup, h)
SELECT symbol, setup, h, CAST(n AS BIGINT) AS n, {q.r('ma')} AS event_mean, {q.r('mb')} AS base_mean, {q.r('(ma - mb) / sqrt(va + vb)', 4)} AS t,
       {q.r('(va + vb) * (va + vb) / (va * va / (n - 1) + vb * vb / (n0 - 1))', 3)} AS dof FROM g WHERE n >= 12"""


@R.add("event_study_all", _STUDY_SQL)
def event_study_all(spark: SparkSession, d: str) -> DataFrame:
    """All nine setups at three horizons, de-overlapped by the horizon, Welch test."""
    b = E.numbered(W.add_forward_returns(W.add_structure(T.bars_li_d(spark, d), S), S, (5, 10, 20)), S)
    out = E.directional_edge(settle(b), {5: "fwd5", 10: "fwd10", 20: "fwd20"})
    return out.select(
        "symbol", "setup", "h", "n", shown("event_mean").alias("event_mean"), shown("base_mean").alias("base_mean"), shown("t", 4).alias("t"),
        shown("dof", 3).alias("dof"),
    )


@R.add(
    "volatility_rank",
    f"""WITH RECURSIVE {_D}, ve AS MATERIALIZED {q.ema_rec('dm', {'a': ('tr', wilder_alpha(14))})},
        vp AS (SELECT db.symbol, db.ts, db.pos, a / close AS v FROM db JOIN ve USING (symbol, pos)),
        vr AS (SELECT x.symbol, x.ts, count(p.pos) AS n, count(CASE WHEN p.v < x.v THEN 1 END) AS below
               FROM vp x LEFT JOIN vp p ON p.symbol = x.symbol AND p.pos < x.pos GROUP BY x.symbol, x.ts)
        SELECT symbol, {q.minute('ts')} AS ts, {q.r('CASE WHEN n >= 249 THEN below / CAST(n AS DOUBLE) END')} AS v_atr_rank FROM vr""",
)
def volatility_rank(spark: SparkSession, d: str) -> DataFrame:
    """The volatility regime of the feature panel: where the average range stands among those of all earlier bars."""
    p = P.feature_panel(T.bars_li_d(spark, d), S)
    return p.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), shown("v_atr_rank").alias("v_atr_rank"))


@R.add("feature_scan")
def feature_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every feature against forward returns on non-overlapping rows (rows only)."""
    p = settle(P.feature_panel(T.bars_li_d(spark, d), S))
    cont = [c for c in p.columns if c[:2] in ("t_", "m_", "r_", "v_")]
    return P.feature_scan(p, S, cont, [c for c, _ in E.SETUPS.values()], (5, 10, 20))


_STOP_SQL = f"""
WITH {_D}, se AS MATERIALIZED {q.ema_rec('dm', {'a': ('tr', wilder_alpha(24)), 'e': ('close', span_alpha(200))})},
sg AS (SELECT db.*, lag(a) OVER (PARTITION BY symbol ORDER BY ts) AS atr, lag(e) OVER (PARTITION BY symbol ORDER BY ts) AS e200 FROM db JOIN se USING (symbol, pos)),
ok AS (SELECT * FROM sg WHERE atr > 0 AND e200 IS NOT NULL AND isodow(ts) <= 4),
gr AS (SELECT * FROM (VALUES (0, 0.25), (1, 0.35), (2, 0.50), (3, 0.75), (4, 1.00), (5, 1.50), (6, NULL)) AS g(i, k)),
tr AS (SELECT symbol, ts, year(ts) AS year, i, k, CASE WHEN low <= open + 0.1 - k * atr THEN open + 0.1 - k * atr ELSE close END - 0.1 - (open + 0.1) AS net FROM ok, gr),
eq AS (SELECT *, sum(net) OVER (PARTITION BY symbol, i ORDER BY ts) AS e FROM tr),
dd AS (SELECT *, e - greatest(0, max(e) OVER (PARTITION BY symbol, i ORDER BY ts)) AS dd FROM eq),
ys AS (SELECT symbol, i, k, year, count(*) AS n, sum(net) AS total, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(net) / (stddev_samp(net) / sqrt(count(*))) AS t, min(dd) AS dd FROM dd GROUP BY ALL),
ps AS (SELECT y.*, p.n0, p.t0, p.d0, p.y0 FROM ys y JOIN LATERAL (SELECT sum(n) AS n0, sum(total) AS t0, min(dd) AS d0, count(*) AS y0 FROM ys z
       WHERE z.symbol = y.symbol AND z.i = y.i AND z.year < y.year) p ON true),
cm AS (SELECT *, CASE WHEN t0 > 0 THEN t0 / NULLIF(-d0, 0) END AS calmar FROM ps WHERE y0 >= 2 AND n0 >= 200 AND n >= 30),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY calmar IS NULL, calmar DESC, CASE WHEN calmar IS NULL AND k IS NULL THEN 0 ELSE 1 END, i) AS rn FROM cm)
SELECT symbol, CAST(year AS INTEGER) AS year, {q.r('k', 2)} AS stop_k, n, {q.r('win')} AS win, {q.r('total', 4)} AS total, {q.r('t', 4)} AS t FROM rk WHERE rn = 1"""


@R.add("walk_forward_stop", _STOP_SQL)
def walk_forward_stop(spark: SparkSession, d: str) -> DataFrame:
    b = P.with_atr_trend(T.bars_li_d(spark, d), S)
    sig = b.where((F.weekday("ts") <= 3) & (F.col("atr") > 0) & F.col("ema200").isNotNull())
    out = P.walk_forward_stop(P.stop_trades(sig, 0.20))
    return out.select(
        "symbol", "year", shown("stop_k", 2).alias("stop_k"), "n", shown("win").alias("win"), shown("total", 4).alias("total"), shown("t", 4).alias("t")
    )


@R.add("placebo_control")
def placebo_control(spark: SparkSession, d: str) -> DataFrame:
    """Trend-filtered entries against hashed random draws of as many rows (rows only)."""
    b = P.with_atr_trend(T.bars_li_d(spark, d), S)
    pool = b.where((F.col("atr") > 0) & F.col("above200")).withColumns(
        {"net": F.col("close") - F.col("open") - 0.20, "row_id": F.concat_ws("|", "symbol", F.col("ts").cast("string"))}
    )
    pool = settle(pool.select("symbol", "ts", "net", "row_id"))
    mine = pool.where(F.weekday("ts") == 0).groupBy("symbol").agg(F.count("net").alias("n"), F.avg("net").alias("mean"))
    draws = E.placebo(pool, ["symbol"], mine.select("symbol", "n"), reps=200, seed=17, value="net", row_id="row_id")
    return E.against_placebo(mine, settle(draws), ["symbol"])


_LL = (1, 5, 15, 30, 60)


@R.add(
    "lead_lag_grid",
    f"""WITH b AS ({q.LI_D}), g AS (SELECT symbol, ts, close, lb, fw, p, f FROM ({' UNION ALL '.join(
        f"SELECT symbol, ts, close, {x} AS lb, {y} AS fw, close / NULLIF({q.lag('close', x)}, 0) - 1 AS p, {q.lead('close', y)} / NULLIF(close, 0) - 1 AS f FROM b" for x in _LL for y in _LL)})),
        s AS (SELECT *, row_number() OVER (PARTITION BY symbol, lb, fw ORDER BY ts) - 1 AS rn FROM g WHERE p IS NOT NULL AND f IS NOT NULL),
        m AS (SELECT symbol, avg(close) AS px FROM b GROUP BY symbol),
        c AS (SELECT symbol, lb, fw, count(*) AS n, corr(p, f) AS r, stddev_samp(f) AS sf FROM s WHERE rn % greatest(lb, fw) = 0 GROUP BY ALL HAVING count(*) >= 50)
        SELECT symbol, lb, fw, n, {q.r('r')} AS corr, {q.r('r * sqrt(n - 2) / sqrt(1 - r * r)', 4)} AS t, {q.r('abs(r * sf) * px', 4)} AS edge_usd,
               {q.r('abs(r * sf) * px / 0.55', 4)} AS vs_spread FROM c JOIN m USING (symbol)""",
)
def lead_lag_grid(spark: SparkSession, d: str) -> DataFrame:
    g = P.lead_lag(T.bars_li_d(spark, d), S, _LL, SPREAD, 50)
    return g.select(
        "symbol", "lb", "fw", "n", shown("corr").alias("corr"), shown("t", 4).alias("t"), shown("edge_usd", 4).alias("edge_usd"),
        shown("vs_spread", 4).alias("vs_spread"),
    )


@R.add(
    "volatility_regimes",
    f"""WITH {_D}, v AS MATERIALIZED (SELECT symbol, ts, pos, {q.roll('stddev_samp', 'ret', 60)} AS rv, close / NULLIF({q.lag('close', 5)}, 0) - 1 AS p,
             {q.lead('close', 15)} / NULLIF(close, 0) - 1 AS f FROM dm),
        k AS (SELECT a.symbol, a.ts, a.p, a.f, (count(*) FILTER (z.rv < a.rv) + (count(*) FILTER (z.rv = a.rv) + 1) / 2.0::DOUBLE) / count(z.rv) AS v, count(z.rv) AS n
              FROM v a JOIN v z ON z.symbol = a.symbol AND z.pos <= a.pos AND z.pos > a.pos - 500 WHERE a.rv IS NOT NULL AND z.rv IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM k WHERE n >= 100 AND p IS NOT NULL AND f IS NOT NULL)
        SELECT symbol, CASE WHEN v < 0.33 THEN 'low' WHEN v < 0.67 THEN 'mid' ELSE 'high' END AS regime, count(*) AS n, {q.r('corr(p, f)')} AS corr,
               {q.r('corr(p, f) * sqrt(count(*) - 2) / sqrt(1 - corr(p, f) * corr(p, f))', 4)} AS t FROM s WHERE rn % 15 = 0 GROUP BY ALL HAVING count(*) >= 10""",
)
def volatility_regimes(spark: SparkSession, d: str) -> DataFrame:
    g = P.volatility_regimes(T.bars_li_d(spark, d), S, 500, 100, 5, 15, 60, 10)
    return g.select("symbol", "regime", "n", shown("corr").alias("corr"), shown("t", 4).alias("t"))


@R.add(
    "annual_drift",
    f"""SELECT symbol, {q.r('(epoch(max(ts)) - epoch(min(ts))) / (365.25::DOUBLE * 86400)')} AS years,
        {q.r('pow(last(close ORDER BY ts) / first(close ORDER BY ts), 1 / ((epoch(max(ts)) - epoch(min(ts))) / (365.25::DOUBLE * 86400))) - 1')} AS cagr FROM ({q.LI_D}) GROUP BY symbol""",
)
def annual_drift(spark: SparkSession, d: str) -> DataFrame:
    return P.drift(T.bars_li_d(spark, d)).withColumns({"years": shown("years"), "cagr": shown("cagr")})


_CARD = ["ema50", "ema200", "atr", "stop", "tp1", "tp2", "tight_stop", "vol_x", "expected_move", "chg_24", "stop_live"]
_PROFILE = "CASE hour " + " ".join(f"WHEN {h} THEN {v}::DOUBLE" for h, v in t.HOUR_PROFILE.items()) + " ELSE 1.05::DOUBLE END"


@R.add(
    "bias_cards",
    f"""WITH {_H}, ce AS MATERIALIZED {q.ema_rec('hm', {'ema50': ('close', span_alpha(50)), 'ema200': ('close', span_alpha(200)), 'atr': ('tr', wilder_alpha(24))})},
        c AS (SELECT hm.*, ema50, ema200, atr, 1.5 * atr AS risk, {_PROFILE} AS vol_x, close / NULLIF(lag(close, 24) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS chg_24,
              CASE WHEN pos >= 210 THEN 'ok' ELSE 'short history' END AS status,
              CASE WHEN pos < 210 THEN NULL WHEN close > ema200 AND close > ema50 THEN 'BULLISH' WHEN close < ema200 AND close < ema50 THEN 'BEARISH' ELSE 'MIXED' END AS bias,
              CASE WHEN pos < 210 THEN NULL WHEN close > ema200 THEN 1 ELSE -1 END AS dirn FROM hm JOIN ce USING (symbol, pos)),
        l AS (SELECT *, close - dirn * risk AS stop, close + dirn * 2 * risk AS tp1, close + dirn * 3 * risk AS tp2, close - dirn * 0.5 * atr AS tight_stop,
              close * (0.221::DOUBLE / 100) * vol_x AS expected_move, close - dirn * risk + (close * 1.01 - close) AS stop_live FROM c)
        SELECT symbol, {q.minute('ts')} AS ts, status, bias, dirn, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN {q.r(c)} END AS {c}' for c in _CARD)},
               CASE WHEN vol_x < 0.85 THEN 'Calm' WHEN vol_x <= 1.30 THEN 'Active' ELSE 'Extreme' END AS vol_state,
               concat_ws(' | ', CASE WHEN dow = 4 THEN 'friday' END, CASE WHEN hour = 17 THEN 'halt' END, CASE WHEN hour = 16 THEN 'before halt' END,
                         CASE WHEN risk <> 0 AND 2 * risk < 0.55 / 0.05 THEN 'spread share' END) AS warnings FROM l""",
)
def bias_cards(spark: SparkSession, d: str) -> DataFrame:
    """Bias, levels, risk state and warnings of every hourly bar; the stop re-anchored to a live price."""
    card = P.bias_card(hourly(spark, d), S)
    live = P.basis_shift(card.withColumn("live_price", F.col("close") * 1.01))
    card = card.join(live.select("symbol", "ts", F.col("stop").alias("stop_live")), ["symbol", "ts"])
    return card.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "status", "bias", "dirn", *[shown(c).alias(c) for c in _CARD], "vol_state",
        F.array_join("warnings", " | ").alias("warnings"),
    )


@R.add(
    "spread_share",
    f"""WITH s AS (SELECT event_type AS symbol, quantile_cont((value + 0.05) - (value - 0.05), 0.5) AS med FROM events WHERE value - 0.05 > 0 GROUP BY 1),
        g AS (SELECT symbol, target, med / target * 100 AS share, med / 0.05 AS min_target FROM s, (VALUES (1), (2), (4), (5), (10), (20)) AS g(target))
        SELECT symbol, target, {q.r('share')} AS share, {q.r('min_target')} AS min_target,
               CASE WHEN share > 15 THEN 'Spread dominates' WHEN share > 5 THEN 'Marginal' ELSE 'Workable' END AS verdict FROM g""",
)
def spread_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of a target the median spread takes, and the smallest target that keeps it under 5 %."""
    ticks = T.event_ticks(spark, d).where(F.col("bid") > 0)
    med = ticks.groupBy("symbol").agg(F.percentile(F.col("ask") - F.col("bid"), F.lit(0.5)).alias("med"))
    g = med.withColumn("target", F.explode(F.array(*[F.lit(x) for x in (1, 2, 4, 5, 10, 20)])))
    share = F.col("med") / F.col("target") * 100
    return g.select(
        "symbol", "target", shown(share).alias("share"), shown(F.col("med") / 0.05).alias("min_target"),
        N.spread_verdict(share).alias("verdict"),
    )
