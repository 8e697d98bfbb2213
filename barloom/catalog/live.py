"""Ticks, bars, source priority, live bias and latched signals, as batch replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as t
from ..functions.num import shown
from ..operators import rolling as W
from ..operators import sessions as N
from ..operators.cross import top_n
from ..operators.ema import add_ema, span_alpha, wilder_alpha
from ..operators.series import plain
from ..operators.settle import shared_folder
from ..sources import tables as T
from ..sources.feeds import last_events
from ..sources.history import History
from ..streaming import latch as L
from ..streaming import ticks as K
from ..streaming.hours import self_biased
from ..streaming.live import live_signals
from ..streaming.priority import source_changes as changes_of
from . import sqlbits as q
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins
S = plain()

_Q = f"tq AS (SELECT *, (bid + ask) / 2 AS price, ask - bid AS spread FROM ({q.TICKS}) WHERE bid > 0 AND ask > 0)"


@R.add(
    "tick_quotes",
    f"""WITH {_Q} SELECT symbol, count(*) AS n, {q.r('avg(price)')} AS mean_price, {q.r('avg(spread)')} AS mean_spread,
        {q.r(f'max({q.rnd("spread / 0.55", 2)})', 2)} AS max_x FROM tq GROUP BY symbol""",
)
def tick_quotes(spark: SparkSession, d: str) -> DataFrame:
    x = K.quotes(T.event_ticks(spark, d))
    return x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), shown(F.avg("price")).alias("mean_price"), shown(F.avg("spread")).alias("mean_spread"),
        shown(F.max("spread_x"), 2).alias("max_x"),
    )


@R.add(
    "tick_bars",
    f"""WITH {_Q} SELECT symbol, {q.minute("date_trunc('hour', ts)")} AS ts, {q.r('first(price ORDER BY ts)')} AS open, {q.r('max(price)')} AS high,
        {q.r('min(price)')} AS low, {q.r('last(price ORDER BY ts)')} AS close, count(*)::DOUBLE AS volume FROM tq GROUP BY symbol, date_trunc('hour', ts)""",
)
def tick_bars(spark: SparkSession, d: str) -> DataFrame:
    b = K.bars(K.quotes(T.event_ticks(spark, d)))
    return b.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), *[shown(c).alias(c) for c in ("open", "high", "low", "close")], "volume"
    )


@R.add(
    "corrected_tick_bars",
    f"""WITH t0 AS (SELECT symbol, ts, bid, ask FROM ({q.TICKS})),
        t1 AS (SELECT symbol, ts, bid, ask, 0 AS rev FROM t0 UNION ALL SELECT symbol, ts, bid, ask, 0 FROM t0
               UNION ALL SELECT symbol, ts, CASE WHEN second(ts) % 7 = 0 THEN NULL ELSE bid + 1 END, ask + 1, 1 FROM t0 WHERE second(ts) % 5 < 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY rev DESC, bid DESC NULLS LAST, ask DESC NULLS LAST) AS rn FROM t1),
        tq AS (SELECT *, (bid + ask) / 2 AS price FROM k WHERE rn = 1 AND bid > 0 AND ask > 0)
        SELECT symbol, {q.minute("date_trunc('hour', ts)")} AS ts, {q.r('first(price ORDER BY ts)')} AS open, {q.r('max(price)')} AS high,
        {q.r('min(price)')} AS low, {q.r('last(price ORDER BY ts)')} AS close, count(*)::DOUBLE AS volume FROM tq GROUP BY symbol, date_trunc('hour', ts)""",
)
def corrected_tick_bars(spark: SparkSession, d: str) -> DataFrame:
    """All ticks sent twice, two seconds in five stated anew a point higher, some of these taken back: each counts once, as last stated."""
    first = T.event_ticks(spark, d).drop("event_id").withColumn("rev", F.lit(0))
    back = F.when(F.second("ts") % 7 != 0, F.col("bid") + 1)
    anew = first.where(F.second("ts") % 5 < 2).withColumns({"bid": back, "ask": F.col("ask") + 1, "rev": F.lit(1)})
    b = K.corrected_bars(first.unionByName(first).unionByName(anew))
    return b.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), *[shown(c).alias(c) for c in ("open", "high", "low", "close")], "volume"
    )


_ASOF = "2024-01-30 12:00:00"


@R.add(
    "source_priority",
    f"""WITH {_Q}, f AS (SELECT symbol, ts, price, 'stream' AS source, 0 AS priority FROM tq WHERE ts <= TIMESTAMP '{_ASOF}' AND event_id % 2 = 0
             UNION ALL SELECT symbol, ts, price, 'poll', 1 FROM tq WHERE ts <= TIMESTAMP '{_ASOF}' AND event_id % 2 = 1
             UNION ALL SELECT symbol, ts, close, 'futures', 3 FROM ({q.EVT_H}) WHERE ts <= TIMESTAMP '{_ASOF}'),
        n AS (SELECT symbol, source, priority, max(ts) AS ts, arg_max(price, ts) AS price FROM f GROUP BY ALL),
        a AS (SELECT *, floor(epoch(TIMESTAMP '{_ASOF}')) - floor(epoch(ts)) AS age FROM n),
        k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority) AS rn FROM a WHERE priority > 0 OR age <= 600)
        SELECT symbol, source, {q.r('price')} AS price, CAST(age AS BIGINT) AS age FROM k WHERE rn = 1""",
)
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    """Streamed price while fresh (ten minutes here), else polled, else futures."""
    x = K.quotes(T.event_ticks(spark, d)).where(F.col("ts") <= _ASOF)
    even = F.col("event_id") % 2 == 0
    live = x.select(
        "symbol", "ts", "price", F.when(even, "stream").otherwise("poll").alias("source"), F.when(even, 0).otherwise(1).alias("priority")
    )
    fut = T.bars_evt_h(spark, d).where(F.col("ts") <= _ASOF).select(
        "symbol", "ts", F.col("close").alias("price"), F.lit("futures").alias("source"), F.lit(3).alias("priority")
    )
    feeds = live.unionByName(fut).withColumn("market_open", F.lit(True))
    out = K.best_source(feeds, F.lit(_ASOF).cast("timestamp"), stale=600)
    return out.select("symbol", "source", shown("price").alias("price"), "age")


def _hour_state(spark: SparkSession, d: str) -> DataFrame:
    b = T.bars_evt_h(spark, d).withColumn("_tr", W.true_range(S))
    return add_ema(
        b, S, {"ema50": ("close", span_alpha(50)), "ema200": ("close", span_alpha(200)), "atr": ("_tr", wilder_alpha(24))}
    )


def _lb(hours: str) -> str:
    """CTEs from hour bars to `lv`, every tick with its bias."""
    return f"""{_Q}, lb AS MATERIALIZED ({q.numbered(f'({hours})')}), lm AS MATERIALIZED ({q.moves('lb')}),
le AS MATERIALIZED {q.ema_rec('lm', {'ema50': ('close', span_alpha(50)), 'ema200': ('close', span_alpha(200)), 'atr': ('tr', wilder_alpha(24))})},
lh AS (SELECT lb.symbol, lb.ts + INTERVAL 1 HOUR AS nxt, lb.pos, ema50, ema200, atr FROM lb JOIN le USING (symbol, pos)),
lj AS (SELECT tq.*, pos, ema50, ema200, atr FROM (SELECT *, date_trunc('hour', ts) AS hr FROM tq) tq ASOF LEFT JOIN lh ON lh.symbol = tq.symbol AND tq.hr >= lh.nxt),
lv AS (SELECT *, CASE WHEN pos IS NULL THEN 'no bars' WHEN pos < 210 THEN 'short history' ELSE 'ok' END AS status,
       CASE WHEN pos < 210 OR pos IS NULL THEN NULL WHEN price > ema200 AND price > ema50 THEN 'BULLISH' WHEN price < ema200 AND price < ema50 THEN 'BEARISH' ELSE 'MIXED' END AS bias,
       CASE WHEN pos < 210 OR pos IS NULL THEN NULL WHEN price > ema200 THEN 1 ELSE -1 END AS dirn FROM lj)"""


_LB = _lb(q.EVT_H)
#: Hour bars of the ticks themselves.
_OWN = """SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, price) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, price) AS close, count(*)::DOUBLE AS volume FROM tq GROUP BY symbol, date_trunc('hour', ts)"""


@R.add(
    "live_bias",
    f"WITH {_LB} SELECT symbol, event_id, status, bias, dirn, CASE WHEN status = 'ok' THEN {q.r('1.5 * atr')} END AS risk FROM lv",
)
def live_bias(spark: SparkSession, d: str) -> DataFrame:
    x = K.live_bias(K.quotes(T.event_ticks(spark, d)), _hour_state(spark, d))
    return x.select("symbol", "event_id", "status", "bias", "dirn", shown("risk").alias("risk"))


def latched(spark: SparkSession, d: str) -> DataFrame:
    return live_signals(T.event_ticks(spark, d), _hour_state(spark, d))


def _fit(x: str) -> str:
    return f"(CASE WHEN abs({x}) >= 1000 THEN round({x}, 2) WHEN abs({x}) >= 1 THEN round({x}, 4) WHEN abs({x}) >= 0.01 THEN round({x}, 6) ELSE round({x}, 10) END)"


_OLD = "d, en, st, t1, t2, ri, iss, bi, mfe, mae"


def latch_sql(src: str, cooldown_min: float) -> str:
    """CTEs from rows `src` (symbol, ts, bias, dirn, price, risk, market_open) to the events of the latch, `ev`: one row of
    state per input row by recursion over numbered rows, then up to three events from the state before and after a row."""
    level = lambda k: _fit(f"(price {k} * risk)")
    return f"""
      lr AS MATERIALIZED (SELECT symbol, ts, bias, dirn, price, risk, market_open, epoch(ts) AS sec, row_number() OVER (PARTITION BY symbol ORDER BY ts, dirn) AS n FROM {src}),
      z AS (SELECT symbol, 0::BIGINT AS n, NULL::VARCHAR AS hit, false AS flip, false AS issue, NULL::VARCHAR AS stat, NULL::INTEGER AS lsd, NULL::DOUBLE AS lst,
              0 AS d, NULL::DOUBLE AS en, NULL::DOUBLE AS st, NULL::DOUBLE AS t1, NULL::DOUBLE AS t2, NULL::DOUBLE AS ri, NULL::TIMESTAMP AS iss, NULL::VARCHAR AS bi,
              0.0::DOUBLE AS mfe, 0.0::DOUBLE AS mae FROM (SELECT DISTINCT symbol FROM lr)
            UNION ALL
            SELECT symbol, n, hit, flip, issue, stat, lsd, lst, d, en, st, t1, t2, ri, iss, bi,
              CASE WHEN d <> 0 AND price > 0 THEN {_fit('greatest(mfe, (price - en) * d)')} ELSE mfe END,
              CASE WHEN d <> 0 AND price > 0 THEN {_fit('least(mae, (price - en) * d)')} ELSE mae END FROM (
              SELECT symbol, n, hit, flip, issue, lsd, lst, price, CASE WHEN issue THEN 'ACTIVE' ELSE stat END AS stat,
                CASE WHEN issue THEN dirn WHEN live THEN d ELSE 0 END AS d, CASE WHEN issue THEN {_fit('price')} ELSE en END AS en,
                CASE WHEN issue THEN {level('- dirn')} ELSE st END AS st, CASE WHEN issue THEN {level('+ dirn * 2.0')} ELSE t1 END AS t1,
                CASE WHEN issue THEN {level('+ dirn * 3.0')} ELSE t2 END AS t2, CASE WHEN issue THEN {_fit('risk')} ELSE ri END AS ri,
                CASE WHEN issue THEN ts ELSE iss END AS iss, CASE WHEN issue THEN bias ELSE bi END AS bi, CASE WHEN issue THEN 0.0 ELSE mfe END AS mfe, CASE WHEN issue THEN 0.0 ELSE mae END AS mae FROM (
                SELECT *, NOT live AND firm AND market_open AND NOT coalesce(lsd = dirn AND (sec - lst) / 60 < {cooldown_min}, false) AS issue FROM (
                  SELECT *, alive AND NOT flip AS live FROM (
                    SELECT *, alive AND firm AND d <> dirn AND bias <> 'MIXED' AS flip FROM (
                      SELECT * REPLACE (CASE WHEN hit = 'STOPPED' THEN d ELSE lsd END AS lsd, CASE WHEN hit = 'STOPPED' THEN sec ELSE lst END AS lst, CASE WHEN hit = 'TP1_HIT' THEN hit ELSE stat END AS stat),
                        d <> 0 AND coalesce(hit, 'TP1_HIT') = 'TP1_HIT' AS alive, coalesce(price > 0 AND bias IS NOT NULL AND risk > 0, false) AS firm FROM (
                        SELECT lr.*, z.* EXCLUDE (symbol, n, hit, flip, issue),
                          CASE WHEN z.d = 0 OR NOT coalesce(price > 0, false) THEN NULL WHEN (price - z.st) * z.d <= 0 THEN 'STOPPED' WHEN (price - z.t2) * z.d >= 0 THEN 'TP2_HIT'
                               WHEN z.stat = 'ACTIVE' AND (price - z.t1) * z.d >= 0 THEN 'TP1_HIT' END AS hit
                        FROM z JOIN lr ON lr.symbol = z.symbol AND lr.n = z.n + 1))))))),
      zz AS (SELECT z.symbol, z.n, z.hit, z.flip, z.issue, lr.ts, lr.price, z.d AS d1, z.en AS en1, z.st AS st1, z.t1 AS t11, z.t2 AS t21, z.ri AS ri1, z.bi AS bi1,
               {', '.join(f'p.{c}' for c in _OLD.split(', '))}, p.stat FROM z JOIN lr USING (symbol, n) JOIN z p ON p.symbol = z.symbol AND p.n = z.n - 1),
      ev AS (SELECT symbol, ts, hit AS event, hit AS status, bi AS bias, d AS dirn, en AS entry, st AS stop, t1 AS tp1, t2 AS tp2, ri AS risk, iss AS issued_ts, price, mfe, mae FROM zz WHERE hit IS NOT NULL
             UNION ALL SELECT symbol, ts, 'FLIPPED', 'FLIPPED', bi, d, en, st, t1, t2, ri, iss, price, mfe, mae FROM zz WHERE flip
             UNION ALL SELECT symbol, ts, 'ISSUED', 'ACTIVE', bi1, d1, en1, st1, t11, t21, ri1, ts, price, 0, 0 FROM zz WHERE issue)"""


_LEVELS = ["entry", "stop", "tp1", "tp2", "risk", "price", "mfe", "mae"]
_SECOND = "'%Y-%m-%d %H:%M:%S'"
_ET = "(ts - INTERVAL 5 HOUR)"
def _live_latch(bars: str) -> str:
    return f"""WITH RECURSIVE {bars},
      li AS (SELECT symbol, ts, bias, dirn, price, CASE WHEN status = 'ok' THEN 1.5 * atr END AS risk,
        NOT (isodow({_ET}) = 5 AND hour({_ET}) >= 17 OR isodow({_ET}) = 6 OR isodow({_ET}) = 7 AND hour({_ET}) < 18 OR hour({_ET}) = 17) AS market_open FROM lv),
      {latch_sql('li', t.STOP_COOLDOWN_MIN)}"""


_LIVE_LATCH = _live_latch(_LB)


def _events_sql(key: str) -> str:
    return f"""SELECT symbol AS {key}, strftime(ts, {_SECOND}) AS ts, event, status, bias, CAST(dirn AS INTEGER) AS dirn, strftime(issued_ts, {_SECOND}) AS issued_ts,
        {', '.join(f'{q.r(c)} AS {c}' for c in _LEVELS)} FROM ev"""


def _events(ev: DataFrame, key: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ev.select(key, stamp("ts"), "event", "status", "bias", "dirn", stamp("issued_ts"), *[shown(c).alias(c) for c in _LEVELS])


@R.add("latched_signals", f"{_LIVE_LATCH} {_events_sql('key')}")
def latched_signals(spark: SparkSession, d: str) -> DataFrame:
    """All events of the latch over every tick."""
    return _events(latched(spark, d), "key")


@R.add("own_hour_signals", f"{_live_latch(_lb(_OWN))} {_events_sql('key')}")
def own_hour_signals(spark: SparkSession, d: str) -> DataFrame:
    """All events of the latch where the averages come from the ticks themselves."""
    return _events(live_signals(T.event_ticks(spark, d)), "key")


_MICRO = "'%Y-%m-%d %H:%M:%S.%f'"
_BIASED = ["price", "ema50", "ema200", "atr", "risk"]


@R.add(
    "streamed_hours",
    f"""WITH RECURSIVE {_lb(_OWN)} SELECT symbol, strftime(ts, {_MICRO}) AS ts, status, bias, CAST(dirn AS INTEGER) AS dirn,
        {', '.join(f'{q.r(c)} AS {c}' for c in _BIASED[:-1])}, CASE WHEN status = 'ok' THEN {q.r('1.5 * atr')} END AS risk
        FROM lv WHERE epoch_us(ts) <= (SELECT (max(epoch_ms(ts)) - 600000) * 1000 FROM tq)""",
)
def streamed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Every tick that the watermark has passed with its bias, by a stream over the table into a history that takes a batch once."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        folder = shared_folder(spark)
        out = self_biased(T.event_ticks(spark, d, stream=True))
        book = History(spark, f"{folder}/book", out.schema)
        run = out.writeStream.foreachBatch(book.sink("hours")).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    x = book.read("hours")
    return x.select(
        "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "status", "bias", "dirn", *[shown(c).alias(c) for c in _BIASED]
    )


@R.add(
    "source_changes",
    f"""WITH {_Q}, f AS (SELECT symbol, ts, price, CASE WHEN event_id % 2 = 0 THEN 'stream' ELSE 'poll' END AS source FROM tq
             UNION ALL SELECT symbol, ts, close, 'futures' FROM ({q.EVT_H})),
        p AS (SELECT symbol, ts FROM f UNION SELECT symbol, ts + to_microseconds(600001000) FROM f
              WHERE source = 'stream' AND ts + to_microseconds(600001000) <= (SELECT max(ts) FROM f)),
        a AS (SELECT p.*, s.ts AS sts, s.price AS sp FROM p ASOF LEFT JOIN (SELECT * FROM f WHERE source = 'stream') s ON p.symbol = s.symbol AND p.ts >= s.ts),
        b AS (SELECT a.*, s.ts AS pts, s.price AS pp FROM a ASOF LEFT JOIN (SELECT * FROM f WHERE source = 'poll') s ON a.symbol = s.symbol AND a.ts >= s.ts),
        c AS (SELECT b.*, s.ts AS fts, s.price AS fp FROM b ASOF LEFT JOIN (SELECT * FROM f WHERE source = 'futures') s ON b.symbol = s.symbol AND b.ts >= s.ts),
        k AS (SELECT *, CASE WHEN ts - INTERVAL 600 SECOND <= sts THEN 'stream' WHEN pts IS NOT NULL THEN 'poll' WHEN fts IS NOT NULL THEN 'futures' END AS source FROM c),
        g AS (SELECT *, lag(source) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM k)
        SELECT symbol, strftime(ts, {_MICRO}) AS ts, source, {q.r("CASE source WHEN 'stream' THEN sp WHEN 'poll' THEN pp ELSE fp END")} AS price,
          CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.symbol = g.symbol AND f.ts = g.ts) THEN 'row' ELSE 'silence' END AS reason
        FROM g WHERE source IS DISTINCT FROM was""",
)
def source_changes(spark: SparkSession, d: str) -> DataFrame:
    """When another source begins to name the price: a row of a better one, or ten minutes of silence of the streamed one."""
    x = K.quotes(T.event_ticks(spark, d))
    live = x.select("symbol", "ts", "price", F.when(F.col("event_id") % 2 == 0, "stream").otherwise("poll").alias("source"))
    fut = T.bars_evt_h(spark, d).select("symbol", "ts", F.col("close").alias("price"), F.lit("futures").alias("source"))
    feeds = live.unionByName(fut).withColumn("market_open", F.lit(True))
    out = changes_of(feeds, {"stream": 0, "poll": 1, "futures": 3}, stale=600)
    return out.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "source", shown("price").alias("price"), "reason")


_VIEW = {"move": "move", "move_r": "move_r", "move_pct": "move_pct", "to_stop": "to_stop", "to_tp1": "to_tp1", "to_tp2": "to_tp2", "age_min": "age_min"}


@R.add(
    "signal_history",
    f"""{_LIVE_LATCH}, hs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event) AS rn FROM ev WHERE event IN ('STOPPED', 'TP2_HIT', 'FLIPPED')),
        hv AS (SELECT *, (price - entry) * dirn AS move FROM hs WHERE rn <= 20)
        SELECT symbol, strftime(ts, {_SECOND}) AS ts, event, CAST(dirn AS INTEGER) AS dirn, {q.r('(floor(epoch(ts)) - floor(epoch(issued_ts))) / 60')} AS age_min, {q.r('move')} AS move,
          {q.r(q.rnd('move / NULLIF(risk, 0)', 2))} AS move_r, {q.r(q.rnd('move / NULLIF(entry, 0) * 100', 2))} AS move_pct,
          {q.r('abs(price - stop)')} AS to_stop, {q.r('abs(tp1 - price)')} AS to_tp1, {q.r('abs(tp2 - price)')} AS to_tp2 FROM hv""",
)
def signal_history(spark: SparkSession, d: str) -> DataFrame:
    """Newest twenty closed signals per key with their view at the closing price."""
    ev = latched(spark, d).where(F.col("event").isin("STOPPED", "TP2_HIT", "FLIPPED"))
    ev = last_events(ev.withColumnRenamed("key", "symbol"), 20, per=["symbol"])
    view = K.signal_view(ev, F.col("price"), F.col("ts"))
    return view.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event", "dirn", *[shown(c).alias(c) for c in _VIEW])


@R.add(
    "open_not_ranked",
    f"""{_LIVE_LATCH}, last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event = 'ISSUED' DESC) AS rn FROM ev),
        best AS (SELECT symbol FROM (SELECT symbol, last(close ORDER BY ts) AS c FROM lb GROUP BY symbol) ORDER BY c DESC, symbol LIMIT 2),
        evo AS (SELECT * EXCLUDE (rn) FROM last WHERE rn = 1 AND event IN ('ISSUED', 'TP1_HIT') AND symbol NOT IN (SELECT symbol FROM best))
        {_events_sql('symbol').replace('FROM ev', 'FROM evo')}""",
)
def open_not_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Signals still open at the end whose key is not among the two best by last price."""
    ev = latched(spark, d)
    last = T.bars_evt_h(spark, d).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    ranked = top_n(last, 2, F.col("close").desc(), F.col("symbol"))
    return _events(K.open_not_ranked(L.open_signals(ev).withColumnRenamed("key", "symbol"), ranked), "symbol")


@R.add(
    "ranked_latch",
    f"""WITH RECURSIVE ub AS (SELECT *, close / NULLIF({q.lag('close')}, 0) - 1 AS ret, close / NULLIF({q.lag('close', 5)}, 0) - 1 AS roc5 FROM ({q.USR_D})),
        uv AS (SELECT * FROM (SELECT *, {q.roll('stddev_samp', 'ret', 10)} AS vol FROM ub) WHERE vol IS NOT NULL AND roc5 IS NOT NULL),
        us AS (SELECT *, 1 AS dirn FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY roc5 DESC, symbol) AS rn FROM uv) WHERE rn <= 10
               UNION ALL SELECT *, -1 FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY roc5, symbol) AS rn FROM uv) WHERE rn <= 10),
        ui AS (SELECT symbol, ts, CASE WHEN dirn > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS bias, dirn, close AS price, close * vol * sqrt({t.HORIZON_DAYS}::DOUBLE) AS risk, true AS market_open
               FROM us WHERE close * vol > 0),
        {latch_sql('ui', t.RANKED_COOLDOWN_MIN)} {_events_sql('key')}""",
)
def ranked_latch(spark: SparkSession, d: str) -> DataFrame:
    """Signals issued day by day from the momentum extremes of the daily panel, long cooldown."""
    from pyspark.sql import Window


    b = T.bars_usr_d(spark, d)
    b = b.withColumns({"ret": W.roc("close", 1, S), "roc5": W.roc("close", 5, S)})
    b = b.withColumn("vol", W.rstd("ret", 10, S)).where(F.col("vol").isNotNull() & F.col("roc5").isNotNull())
    unit = F.col("close") * F.col("vol") * F.sqrt(F.lit(float(t.HORIZON_DAYS)))
    # the rank filters keep ten rows per task and day
    up = Window.partitionBy("ts").orderBy(F.col("roc5").desc(), "symbol")
    dn = Window.partitionBy("ts").orderBy("roc5", "symbol")
    longs = b.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= 10).withColumn("side", F.lit("long"))
    shorts = b.withColumn("_r", F.row_number().over(dn)).where(F.col("_r") <= 10).withColumn("side", F.lit("short"))
    rows = longs.unionByName(shorts).withColumn("risk_unit", unit)
    return _events(L.latch_batch(L.ranked_rows(rows), t.RANKED_COOLDOWN_MIN), "key")


@R.add(
    "parity_sample",
    f"""WITH {_Q}, s AS (SELECT symbol, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS slot, max(ts) AS ts, arg_max(price, ts) AS price FROM tq GROUP BY ALL)
        SELECT symbol, {q.minute('ts')} AS ts, {q.r('price')} AS price FROM s""",
)
def parity_sample(spark: SparkSession, d: str) -> DataFrame:
    x = K.parity_sample(K.quotes(T.event_ticks(spark, d)), seconds=3600)
    return x.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), shown("price").alias("price"))
