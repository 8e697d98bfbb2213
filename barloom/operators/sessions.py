"""Exchange time, session ranges, hour rules and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions import tables as t
from ..functions.num import ratio
from . import events
from .rolling import add_equity, add_losing_run
from .series import Series
from .settle import settle


def add_clock(df: DataFrame, zone: str = t.ZONE) -> DataFrame:
    """Exchange-local time, hour, weekday (Monday 0) and the session day that starts at 18:00."""
    df = df.withColumn("ts_et", F.from_utc_timestamp("ts", zone))
    return df.withColumns(
        {
            "hour": F.hour("ts_et"),
            "dow": F.weekday("ts_et"),
            "session_date": F.to_date(F.col("ts_et") - F.expr("INTERVAL 18 HOURS")),
        }
    )


def market_status(df: DataFrame) -> DataFrame:
    """Open Sunday 18:00 to Friday 17:00 with a halt at 17:00; needs ts_et, hour, dow."""
    c = F.col
    reason = (
        F.when((c("dow") == 4) & (c("hour") >= 17), "weekend break since Friday")
        .when(c("dow") == 5, "weekend break")
        .when((c("dow") == 6) & (c("hour") < 18), "weekend break, reopens today")
        .when(c("hour") == 17, "daily halt")
    )
    days = F.when((c("dow") == 4) & (c("hour") >= 17), 2).when(c("dow") == 5, 1).otherwise(0)
    six_pm = F.date_trunc("day", "ts_et") + F.make_dt_interval(days, F.lit(18))
    return df.withColumns(
        {
            "reason": F.coalesce(reason, F.lit("")),
            "market_open": reason.isNull(),
            "reopens": F.when(reason.isNotNull(), six_pm),
        }
    )


def profile_of(hour: Column) -> Column:
    """Relative volatility of an hour; hours without one (the halt) use 18:00."""
    pairs = [x for h, v in t.HOUR_PROFILE.items() for x in (F.lit(h), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[hour], F.lit(t.HOUR_PROFILE[18]))


def expected_move(price: Column, hour: Column) -> Column:
    return price * (t.BASE_HOURLY_SIGMA_PCT / 100.0) * profile_of(hour)


def vol_state(x: Column) -> Column:
    return F.when(x < 0.85, "Calm").when(x <= 1.30, "Active").otherwise("Extreme")


def spread_verdict(share: Column) -> Column:
    return F.when(share > 15, "Spread dominates").when(share > 5, "Marginal").otherwise("Workable")


def volatility_by_hour(df: DataFrame) -> DataFrame:
    """sigma of returns per hour, its ratio to the overall sigma of the symbol, median ATR."""
    overall = df.groupBy("symbol").agg(F.stddev_samp("ret").alias("_all"))
    by_hour = df.groupBy("symbol", "hour").agg(
        F.stddev_samp("ret").alias("sigma"), F.count("ret").alias("n"), F.median("atr").alias("median_atr")
    )
    return by_hour.join(overall, "symbol").withColumn("x", ratio("sigma", "_all")).drop("_all")


def result_by_hour(df: DataFrame, value: str, min_n: int) -> DataFrame:
    """n, mean, t and hit rate per hour, ranked by |t| and by mean within the symbol."""
    out = (
        df.groupBy("symbol", "hour")
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            st.t_one(value).alias("t"),
            st.hit(value).alias("hit"),
        )
        .where(F.col("n") >= min_n)
    )
    # at most 24 rows per symbol
    by_t = Window.partitionBy("symbol").orderBy(F.abs("t").desc(), "hour")
    by_mean = Window.partitionBy("symbol").orderBy(F.col("mean").desc(), "hour")
    return out.withColumns({"rank_t": F.row_number().over(by_t), "rank_mean": F.row_number().over(by_mean)})


def session_range(df: DataFrame, from_hour: int, to_hour: int, min_bars: int) -> DataFrame:
    """Range of an overnight window per session day, joined back to every bar of that day."""
    inside = df.where((F.col("hour") >= from_hour) | (F.col("hour") <= to_hour))
    rng = (
        inside.groupBy("symbol", "session_date")
        .agg(F.max("high").alias("r_high"), F.min("low").alias("r_low"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_bars)
        .drop("_n")
    )
    return df.join(rng, ["symbol", "session_date"], "left")


def first_breaks(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """First close beyond the session range between two hours, per session day and direction."""
    side = F.when(F.col("close") > F.col("r_high"), 1).when(F.col("close") < F.col("r_low"), -1)
    hits = df.where(F.col("hour").between(lo, hi)).withColumn("dirn", side).where(F.col("dirn").isNotNull())
    w = Window.partitionBy("symbol", "session_date", "dirn").orderBy("ts")
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def zone_trades(outcomes: DataFrame, zones: list[tuple[str, int]]) -> DataFrame:
    """The outcomes whose row is at the hour of a zone, with its name as `zone`; hours of several zones give a row for each."""
    named = [F.when(F.col("hour") == h, F.lit(name)) for name, h in zones]
    return outcomes.withColumn("zone", F.explode(F.array_compact(F.array(*named))))


def zone_control(outcomes: DataFrame, zones: list[tuple[str, int]], reps: int, seed: int, least: int = 30) -> DataFrame:
    """Mean result of each zone and direction with `least` trades, against `reps` random draws of as many rows of the same symbol and direction.

    outcomes: symbol, ts, hour, dirn, r, one row per entry that could be taken; it is read twice, so let it be settled.
    """
    by = ["symbol", "zone", "dirn"]
    taken = zone_trades(outcomes, zones).groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("mean"))
    taken = taken.where(F.col("n") >= least)
    pool = outcomes.select("symbol", "dirn", "ts", "r", F.explode(F.array(*[F.lit(name) for name, _ in zones])).alias("zone"))
    return events.against_placebo(taken, settle(events.placebo(pool, by, taken.select(*by, "n"), reps, seed, "r", "ts")), by)


def hour_trades(df: DataFrame, s: Series, hour: int, spread: Column, last_dow: int = 6) -> DataFrame:
    """Enter at the close of the hour's bar, leave at the next bar's close (whatever hour that is)."""
    o = s.ordered()
    df = df.withColumns(
        {
            "exit": F.lead("close").over(o),
            "exit_ts": F.lead("ts").over(o),
            "exit_open": F.lead("open").over(o),
        }
    )
    df = df.where((F.col("hour") == hour) & (F.col("dow") <= last_dow) & F.col("exit").isNotNull())
    gross = F.col("exit") - F.col("close")
    return df.withColumns(
        {
            "entry": F.col("close"),
            "gross": gross,
            "net": gross - spread,
            "win": gross - spread > 0,
            "hold_h": (F.unix_seconds("exit_ts") - F.unix_seconds("ts")) / 3600.0,
            "gap": F.col("exit_open") - F.col("close"),
            "bar": F.col("exit") - F.col("exit_open"),
        }
    )


def record(trades: DataFrame, s: Series, by: list[str], net: str = "net") -> DataFrame:
    """Trade record per group: result, worst and best, drawdown from the opening balance, losing run."""
    part = Series(keys=tuple(by), ts=s.ts, part=tuple(by), order=(s.ts,))
    df = trades.withColumn("_w", F.col(net) > 0)
    df = add_losing_run(add_equity(df, part, net), part, "_w")
    days = F.datediff(F.max(s.ts), F.min(s.ts)) / 365.25
    return df.groupBy(*by).agg(
        F.count(net).alias("n"),
        st.hit(net).alias("win"),
        F.avg(net).alias("mean"),
        F.sum(net).alias("total"),
        st.profit_factor(net).alias("pf"),
        F.min(net).alias("worst"),
        F.max(net).alias("best"),
        F.min("drawdown").alias("max_dd"),
        F.max("losing_run").alias("streak"),
        st.t_one(net).alias("t"),
        ratio(F.sum(net), -F.min("drawdown")).alias("calmar"),
        ratio(F.sum(net), F.greatest(days, F.lit(0.01))).alias("per_year"),
    )


def by_period(trades: DataFrame, holdout: str, ts: str = "ts") -> DataFrame:
    """Every trade once for the full period, once for train or holdout, once for its calendar year (`period`).

    The holdout is the interval up to the newest trade of all.
    """
    last = F.broadcast(trades.agg(F.max(ts).alias("_last")))
    late = F.when(F.col(ts) <= F.col("_last") - F.expr(holdout), "train").otherwise("holdout")
    periods = F.explode(F.array(F.lit("full"), late, F.year(ts).cast("string")))
    return trades.crossJoin(last).withColumn("period", periods).drop("_last")


def overnight_split(trades: DataFrame, cost: float) -> DataFrame:
    """Gap and bar parts of the trades for all days, Fridays and the other days in one pass."""
    df = trades.withColumns({"friday": F.col("dow") == 4, "total_net": F.col("gross") - cost})
    agg = [F.count(F.lit(1)).alias("n"), F.percentile("hold_h", F.lit(0.5)).alias("median_hold")]
    for x in ("gap", "bar", "total_net"):
        agg += [F.avg(x).alias(f"{x}_mean"), st.t_one(x).alias(f"{x}_t"), st.hit(x).alias(f"{x}_hit")]
    agg += [
        F.min("total_net").alias("worst"),
        F.percentile("total_net", F.lit(0.05)).alias("p05"),
        F.stddev_pop("total_net").alias("sd"),
    ]
    sets = df.groupingSets([["symbol"], ["symbol", "friday"]], "symbol", "friday").agg(*agg)
    days = F.when(F.col("friday").isNull(), "all").when(F.col("friday"), "friday").otherwise("other")
    return sets.withColumn("days", days).drop("friday")


def loss_concentration(trades: DataFrame, cost: float, k: int = 10) -> DataFrame:
    """Where the k worst trades of a symbol come from: Friday share and share of the gap."""
    df = trades.withColumn("total_net", F.col("gross") - cost)
    w = Window.partitionBy("symbol").orderBy("total_net", "ts")
    worst = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    share = ratio(F.abs("gap"), F.abs("gap") + F.abs("bar"))
    return worst.groupBy("symbol").agg(
        F.count_if(F.col("dow") == 4).alias("fridays"),
        F.avg(share).alias("gap_share"),
        F.min("total_net").alias("worst"),
    )


def session_averages(profile: DataFrame, sessions: DataFrame) -> DataFrame:
    """profile: symbol, hour, x.  sessions: name, hour (a fixed list of 23 rows)."""
    return profile.join(F.broadcast(sessions), "hour").groupBy("symbol", "session").agg(
        F.avg("x").alias("mean_x"), F.count(F.lit(1)).alias("hours")
    )
