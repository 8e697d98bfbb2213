"""Bars, quotes, feeds, universe and other row-level operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import shown
from ..operators import universe as U
from ..operators.series import plain
from ..sources import feeds
from ..sources import tables as T
from . import sqlbits as q
from .registry import Registry

R = Registry()
QUERIES, TWINS = R.queries, R.twins


def _bars_out(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
        *[shown(c, 8).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )


def _bars_sql(src: str) -> str:
    cols = ", ".join(f"{q.r(c, 8)} AS {c}" for c in ("open", "high", "low", "close", "volume"))
    return f"SELECT symbol, {q.minute('ts')} AS ts, {cols} FROM ({src})"


@R.add("bars_hourly_by_type", _bars_sql(q.EVT_H))
def bars_hourly_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _bars_out(T.bars_evt_h(spark, d))


@R.add("bars_daily_by_user", _bars_sql(q.USR_D))
def bars_daily_by_user(spark: SparkSession, d: str) -> DataFrame:
    return _bars_out(T.bars_usr_d(spark, d))


@R.add("bars_weekly_by_supplier", _bars_sql(q.LI_W))
def bars_weekly_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    return _bars_out(T.bars_li_w(spark, d))


@R.add(
    "panel_union",
    f"""WITH p AS (SELECT 'H:' || symbol AS symbol, ts, close FROM ({q.EVT_H})
               UNION ALL SELECT 'D:' || symbol, ts, close FROM ({q.LI_D}))
        SELECT symbol, count(*) AS n, {q.minute('min(ts)')} AS first_ts,
               {q.minute('max(ts)')} AS last_ts, {q.r('avg(close)')} AS mean_close
        FROM p GROUP BY symbol""",
)
def panel_union(spark: SparkSession, d: str) -> DataFrame:
    """One panel from several sources, and its coverage per symbol."""
    panel = feeds.union_panels(
        T.bars_evt_h(spark, d).withColumn("symbol", F.concat(F.lit("H:"), "symbol")),
        T.bars_li_d(spark, d).withColumn("symbol", F.concat(F.lit("D:"), "symbol")),
    )
    return panel.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("first_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last_ts"),
        shown(F.avg("close")).alias("mean_close"),
    )


@R.add(
    "latest_quotes",
    f"""WITH n AS (SELECT *, {q.lag('close')} AS prev,
                     row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back,
                     count(*) OVER (PARTITION BY symbol) AS n FROM ({q.LI_W}))
        SELECT symbol, {q.r('close', 8)} AS price, {q.r('open', 8)} AS open, {q.r('high', 8)} AS high,
               {q.r('low', 8)} AS low, {q.r('volume', 8)} AS volume,
               {q.r('(close - prev) / NULLIF(prev, 0) * 100', 8)} AS change_pct, {q.r('prev', 8)} AS prev_close
        FROM n WHERE back = 1 AND n >= 2""",
)
def latest_quotes(spark: SparkSession, d: str) -> DataFrame:
    out = U.latest_quotes(T.bars_li_w(spark, d))
    return out.select("symbol", *[shown(c, 8).alias(c) for c in out.columns if c != "symbol"])


@R.add(
    "keep_last_per_bar",
    f"""WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bar, event_id, value,
                     row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts)
                                        ORDER BY ts DESC, event_id DESC) AS rn FROM events)
        SELECT symbol, {q.minute('bar')} AS ts, event_id, {q.r('value')} AS value FROM e WHERE rn = 1""",
)
def keep_last_per_bar(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates per (symbol, hour): the last one to arrive stays."""
    e = T.table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("hour", "ts").alias("bar"),
        "ts",
        "event_id",
        "value",
    )
    kept = feeds.keep_last(e, ["symbol", "bar"], ["ts", "event_id"])
    return kept.select(
        "symbol",
        F.date_format("bar", "yyyy-MM-dd HH:mm").alias("ts"),
        "event_id",
        shown("value").alias("value"),
    )


@R.add(
    "grouped_feed_normalised",
    f"""SELECT symbol, {q.minute('ts')} AS ts, {q.r('close')} AS close, {q.r('volume')} AS volume,
               {q.r("CASE WHEN volume > 200 THEN (open + close) / 2 ELSE close END")} AS vwap
        FROM ({q.EVT_H}) WHERE NOT (volume <= 20)""",
)
def grouped_feed_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Feed rows in short keys and epoch milliseconds, some without vwap, some without a price."""
    b = T.bars_evt_h(spark, d)
    raw = b.select(
        F.to_json(
            F.struct(
                F.concat(F.lit("X:"), F.upper("symbol"), F.lit("USD")).alias("T"),
                F.col("open").alias("o"),
                F.col("high").alias("h"),
                F.col("low").alias("l"),
                F.when(F.col("volume") > 20, F.col("close")).alias("c"),
                F.col("volume").alias("v"),
                F.when(F.col("volume") > 200, (F.col("open") + F.col("close")) / 2).alias("vw"),
                F.unix_millis("ts").alias("t"),
            )
        ).alias("value")
    )
    out = feeds.normalise_feed(raw)
    return out.select(
        F.lower(feeds.short_symbol(F.col("symbol"))).alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"),
        shown("close").alias("close"),
        shown("volume").alias("volume"),
        shown("vwap").alias("vwap"),
    )


@R.add(
    "archive_ingest",
    f"""WITH t AS (SELECT symbol, ts, round(close, 2) AS close,
                     CAST(100 + CAST(floor(volume) AS BIGINT) % 400 AS INTEGER) AS spread
                   FROM ({q.EVT_H})),
             s AS (SELECT symbol, CAST(spread AS DOUBLE) * 0.001::DOUBLE AS sp FROM t)
        SELECT symbol, count(*) AS n, {q.r('quantile_cont(sp, 0.5)')} AS median_spread,
               {q.r('avg(sp)')} AS mean_spread, {q.r('quantile_cont(sp, 0.9)')} AS p90_spread,
               {q.r('quantile_cont(sp, 0.99)')} AS p99_spread,
               {q.r('quantile_cont(sp, 0.5) / 5.0 * 100')} AS share_of_5
        FROM s GROUP BY symbol""",
)
def archive_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pulls merged on (symbol, time), then the spread distribution."""
    b = T.bars_evt_h(spark, d).select(
        "symbol",
        "ts",
        F.round("close", 2).alias("close"),
        (100 + F.floor("volume") % 400).cast("int").alias("spread"),
    )
    merged = feeds.merge_pulls(b, b.where(F.dayofmonth("ts") % 2 == 0))
    out = U.spread_distribution(merged.withColumn("spread_usd", feeds.points_to_dollars(F.col("spread"))), "spread_usd", 5.0)
    names = ["median_spread", "mean_spread", "p90_spread", "p99_spread"]
    return out.select("symbol", "n", *[shown(c).alias(c) for c in names], shown("share_of_target").alias("share_of_5"))


_U_STATS = f"""
  u AS (SELECT *, close / NULLIF({q.lag('close')}, 0) - 1 AS ret FROM ({q.LI_W})),
  st AS (SELECT symbol, quantile_cont(volume * close, 0.5) AS med_dv, count(*) AS n,
                stddev_samp(ret) * sqrt(365) * 100 AS ann_vol FROM u GROUP BY symbol)"""


@R.add(
    "universe_filter",
    f"""WITH {_U_STATS}
        SELECT symbol, {q.r('med_dv', 4)} AS med_dv, n, {q.r('ann_vol', 4)} AS ann_vol
        FROM st WHERE med_dv >= 40000 AND ann_vol >= 10 AND n >= 120""",
)
def universe_filter(spark: SparkSession, d: str) -> DataFrame:
    st = U.universe_stats(T.bars_li_w(spark, d), plain())
    kept = U.passing(st, min_dollar_volume=40_000.0, min_vol_pct=10.0, min_rows=120)
    return kept.select("symbol", shown("med_dv", 4).alias("med_dv"), "n", shown("ann_vol", 4).alias("ann_vol"))


@R.add(
    "proxy_drop",
    f"""WITH u AS (SELECT *, close / NULLIF({q.lag('close')}, 0) - 1 AS ret FROM ({q.LI_W})),
        b AS (SELECT ts, ret AS rb FROM u WHERE symbol = 'S1'),
        g AS (SELECT ts, ret AS rg FROM u WHERE symbol = 'S2'),
        c AS (SELECT u.symbol, corr(u.ret, b.rb) AS cb, corr(u.ret, g.rg) AS cg
              FROM u LEFT JOIN b USING (ts) LEFT JOIN g USING (ts) GROUP BY u.symbol)
        SELECT symbol, {q.r('cb')} AS corr_bench, {q.r('cg')} AS corr_ref
        FROM c WHERE symbol <> 'S1' AND cg IS NOT NULL AND cb IS NOT NULL AND cg > cb""",
)
def proxy_drop(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that follow the reference asset more than the benchmark."""
    out = U.proxies(T.bars_li_w(spark, d), plain(), bench="S1", reference="S2")
    return out.select("symbol", shown("cb").alias("corr_bench"), shown("cg").alias("corr_ref"))


@R.add(
    "liquid_candidates",
    f"""WITH b AS (SELECT * FROM ({q.USR_D})),
        d0 AS (SELECT max(ts) AS ts FROM b
               WHERE ts <= TIMESTAMP '2024-02-02' AND ts > TIMESTAMP '2024-02-02' - INTERVAL 5 DAY)
        SELECT symbol, {q.r('volume * close')} AS dollar_volume,
               row_number() OVER (ORDER BY volume * close DESC, symbol) AS rank
        FROM b JOIN d0 USING (ts) WHERE symbol LIKE '%7' ORDER BY 2 DESC, 1 LIMIT 25""",
)
def liquid_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Top names by one day's dollar volume, stepping back over empty days; suffix as quote currency."""
    return U.candidates(T.bars_usr_d(spark, d), on="2024-02-02", back=5, suffix="7", n=25).select(
        "symbol", shown("dollar_volume").alias("dollar_volume"), "rank"
    )


@R.add(
    "freshness_audit",
    f"""WITH uni AS (SELECT symbol, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM (
             SELECT 'U' || CAST(c_custkey AS VARCHAR) AS symbol, 'all' AS list FROM customer
             UNION ALL SELECT 'U' || CAST(c_custkey AS VARCHAR), 'seg/' || c_mktsegment FROM customer)
             GROUP BY symbol),
        l AS (SELECT symbol, max(ts) AS last_ts FROM ({q.USR_D}) GROUP BY symbol)
        SELECT symbol, lists, {q.day('last_ts')} AS last_bar,
               CASE WHEN last_ts IS NULL THEN 'DEAD'
                    WHEN date_diff('day', last_ts, TIMESTAMP '2024-02-05') > 10 THEN 'STALE' ELSE 'OK' END AS state
        FROM uni LEFT JOIN l USING (symbol)""",
)
def freshness_audit(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select(
        F.concat(F.lit("U"), "c_custkey").alias("symbol"),
        F.explode(F.array(F.lit("all"), F.concat(F.lit("seg/"), "c_mktsegment"))).alias("list"),
    )
    return U.freshness(c, T.bars_usr_d(spark, d), asof="2024-02-05").select(
        "symbol", "lists", F.date_format("last_ts", "yyyy-MM-dd").alias("last_bar"), "state"
    )


@R.add(
    "universe_union",
    """SELECT DISTINCT symbol FROM (
         SELECT n_name AS symbol FROM nation UNION ALL SELECT r_name FROM region
         UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT r_name FROM region)""",
)
def universe_union(spark: SparkSession, d: str) -> DataFrame:
    lists = [
        T.table(spark, d, "nation").select(F.col("n_name").alias("symbol")),
        T.table(spark, d, "region").select(F.col("r_name").alias("symbol")),
        T.table(spark, d, "customer").select(F.col("c_mktsegment").alias("symbol")),
    ]
    return U.universe(*lists)


@R.add(
    "missing_names",
    f"""WITH w AS (SELECT symbol, min(pos) AS first_pos FROM (
                    SELECT 'U' || CAST(o_custkey AS VARCHAR) AS symbol, o_orderkey AS pos FROM orders)
                  GROUP BY symbol),
        h AS (SELECT DISTINCT symbol FROM ({q.USR_D}))
        SELECT symbol, first_pos, row_number() OVER (ORDER BY first_pos, symbol) AS place
        FROM w WHERE symbol NOT IN (SELECT symbol FROM h) ORDER BY first_pos, symbol LIMIT 50""",
)
def missing_names(spark: SparkSession, d: str) -> DataFrame:
    """Requested names (repeats removed, first place kept) that have no bars."""
    asked = T.table(spark, d, "orders").select(
        F.concat(F.lit("U"), "o_custkey").alias("symbol"), F.col("o_orderkey").alias("pos")
    )
    return U.not_scored(U.first_places(asked), T.bars_usr_d(spark, d), 50)


@R.add(
    "price_validity",
    f"""WITH l AS (SELECT symbol, last(close ORDER BY ts) AS last_close FROM ({q.USR_D}) GROUP BY symbol),
        c AS (SELECT 'U' || CAST(c_custkey AS VARCHAR) AS symbol, c_acctbal AS quote FROM customer)
        SELECT symbol, {q.r('CASE WHEN quote > 0 THEN quote ELSE last_close END')} AS price
        FROM c LEFT JOIN l USING (symbol)
        WHERE last_close IS NOT NULL AND CASE WHEN quote > 0 THEN quote ELSE last_close END > 0""",
)
def price_validity(spark: SparkSession, d: str) -> DataFrame:
    """A quote of zero or less is no quote: use the last close; no close, no row."""
    quotes = T.table(spark, d, "customer").select(
        F.concat(F.lit("U"), "c_custkey").alias("symbol"), F.col("c_acctbal").alias("quote")
    )
    return U.valid_price(quotes, T.bars_usr_d(spark, d)).select("symbol", shown("price").alias("price"))


@R.add(
    "history_filter",
    f"""WITH b AS (SELECT * FROM ({q.LI_W}) WHERE open IS NOT NULL AND close IS NOT NULL)
        SELECT symbol, count(*) AS n FROM b GROUP BY symbol HAVING count(*) >= 250 + 20 + 20""",
)
def history_filter(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with enough complete bars for warm-up, longest horizon and slack."""
    b = U.complete(T.bars_li_w(spark, d))
    return U.enough_history(b, 250 + 20 + 20).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
