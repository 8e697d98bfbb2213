"""Point-in-time evaluation of scores: walk-forward panels, summaries, model comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.num import ratio
from .cross import calendar, decile_edges, middle_date, rank_ic, rank_ics, rebalance_dates, zscores
from .series import Series, dealt
from .settle import settle


def usable(bars: DataFrame, s: Series, least: int, rows: int) -> DataFrame:
    """Bars of symbols with at least `least` of them, dealt as the windows of a panel need them; `rows` is about their number.

    The bars of a symbol are counted where its windows run and in the order these sort by, so bars move once.
    """
    whole = s.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = dealt(bars, rows, *s.part).dropna(subset=list(s.keys))
    return b.withColumn("_held", F.count(F.lit(1)).over(whole)).where(F.col("_held") >= least).drop("_held")


def point_in_time(
    panel: DataFrame, s: Series, dates: DataFrame, cal: DataFrame, warmup: int, horizons: tuple[int, ...], step: int
) -> DataFrame:
    """Panel rows as seen on each rebalance date, with forward returns.

    The row of date d is the last bar at or before d.  A bar stays current until the next bar of its
    symbol, so it is repeated for the rebalance days in that gap by arithmetic on day numbers:
    no symbol-by-date cross join and no range join.  The calendars have a row per date and are broadcast: wide rows dealt by
    date would move the panel twice and gather a date in a task.  Forward bars count from the first bar at or after d.
    """
    o = s.ordered()
    max_h = max(horizons)
    p = panel.join(F.broadcast(cal), "ts")
    leads = {f"_l{h}": F.lead("close", h).over(o) for x in horizons for h in (x, x + 1)}
    p = p.withColumns(
        {"_next": F.coalesce(F.lead("day_no", 1).over(o), F.col("day_no") + 1), **leads}
    )
    first = F.lit(warmup) + F.ceil((F.greatest(F.col("day_no"), F.lit(warmup)) - warmup) / step) * step
    p = p.withColumn("_first", first.cast("int")).where(
        (F.col("row_no") >= warmup) & (F.col("_first") < F.col("_next"))
    )
    days = F.sequence(F.col("_first"), F.col("_next") - 1, F.lit(step))
    p = p.withColumn("_day", F.explode(days))
    exact = F.col("_day") == F.col("day_no")
    fwd = {
        f"fwd{h}": ratio(F.when(exact, F.col(f"_l{h}")).otherwise(F.col(f"_l{h + 1}")), "close") - 1
        for h in horizons
    }
    d = dates.select(F.col("day_no").alias("_day"), F.col("ts").alias("date"))
    p = p.withColumns(fwd).join(F.broadcast(d), "_day")
    return p.where(F.col(f"fwd{max_h}").isNotNull() & (F.col("close") > 0)).drop(
        "_next", "_first", "_day", "day_no", *leads
    )


def walk_forward(
    bars: DataFrame, panel_of, s: Series, warmup: int, step: int, horizons: tuple[int, ...]
) -> DataFrame:
    """Score every bar once, then look at it on each rebalance date.

    The symbols, the calendar and the number of tasks come from a table with a row per symbol, for which only the keys of the bars are
    read.  The result is settled: every evaluation ranks it several times.
    """
    max_h = max(horizons)
    least = warmup + max_h + 20
    day = F.struct(F.col("ts"))
    lives = bars.dropna(subset=list(s.keys)).groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"), F.collect_set(day).alias("_days"))
    lives = settle(lives.where(F.col("_n") >= least))
    rows = lives.agg(F.sum("_n")).first()[0] or 0
    days = settle(lives.select(F.explode("_days").alias("_d")).select("_d.ts").distinct())
    dates = rebalance_dates(days, warmup, max_h, step)
    kept = usable(bars, s, least, rows)
    return settle(point_in_time(panel_of(kept), s, dates, calendar(days), warmup, horizons, step))


def summarise(df: DataFrame, by: list[str], value: str, min_n: int = 1, ddof: int = 1) -> DataFrame:
    """n, mean, sd, ir, t, positive share of a per-date series."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        st.ir(value, ddof).alias("ir"),
        st.t_one(value).alias("t"),
        st.hit(value).alias("pos"),
    )
    return out.where(F.col("n") >= min_n)


def long_form(df: DataFrame, ids: list[str], values: list[str], name: str = "feature") -> DataFrame:
    return df.unpivot(ids, [F.col(v).cast("double").alias(v) for v in values], name, "value")


def feature_ics(df: DataFrame, features: list[str], horizons: list[str]) -> DataFrame:
    """IC per (feature, horizon, date): the panel is unpivoted and ranked once for all features and horizons."""
    return rank_ics(long_form(df, ["date", *horizons], features), ["feature", "date"], "value", horizons)


def sign_fit(df: DataFrame, subs: dict[str, float], fwd: str) -> tuple[DataFrame, DataFrame]:
    """Signs and |IC| weights from the first half of the dates.

    Returns the (feature, is_ic, oos_ic, sign, weight, ic_weight) table and the panel with both
    composites and a `late` flag.  The weights are a table of len(subs) rows and go to the rows of the panel as one map, so the panel is
    neither unpivoted for the composites nor joined to them.
    """
    split = F.broadcast(settle(middle_date(df.select(F.col("date").alias("ts")))))
    df = df.crossJoin(split).withColumn("late", F.col("date") >= F.col("split")).drop("split")
    long = long_form(df, ["date", "late", fwd], list(subs))
    ics = rank_ic(long, ["feature", "late", "date"], "value", fwd)
    fit = settle(ics).groupBy("feature").agg(
        F.avg(F.when(~F.col("late"), F.col("ic"))).alias("is_ic"),
        F.avg(F.when(F.col("late"), F.col("ic"))).alias("oos_ic"),
    )
    given = F.create_map(*[x for k, w in subs.items() for x in (F.lit(k), F.lit(w))])
    total = fit.agg(F.sum(F.abs("is_ic")).alias("_tot"))
    fit = settle(fit.crossJoin(F.broadcast(total)).select(
        "feature",
        "is_ic",
        "oos_ic",
        F.when(F.col("is_ic") < 0, -1.0).otherwise(1.0).alias("sign"),
        given[F.col("feature")].alias("weight"),
        ratio(F.abs("is_ic"), "_tot").alias("ic_weight"),
    ))
    z = zscores(df, list(subs), by="date", clip=None, flat=0.0)
    of = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("sign", "weight", "ic_weight"))))
    z = z.crossJoin(F.broadcast(fit.agg(of.alias("_fit")))).where(F.size("_fit") > 0)

    def composite(weight: str):
        """The sum of the terms that are known, NULL without any."""
        terms = [F.col(f"{k}_z") * F.col("_fit")[k]["sign"] * F.col("_fit")[k][weight] for k in subs]
        some = reduce(lambda a, b: a | b, [x.isNotNull() for x in terms])
        return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in terms]))

    z = z.withColumns({"corrected": composite("weight"), "icweighted": composite("ic_weight")})
    return fit, settle(z.select("date", "symbol", *[c for c in [*df.columns, "corrected", "icweighted"] if c not in ("date", "symbol")]))


def compare(df: DataFrame, models: list[str], fwd: str, min_n: int = 20, min_dates: int = 5) -> DataFrame:
    """Models x cadences (every date, every 4th) x windows (early, late, full)."""
    long = settle(long_form(df, ["date", "symbol", fwd], models, "model"))
    ics = rank_ic(long, ["model", "date"], "value", fwd, more_than=min_n - 1, distinct_over=3)
    edges = decile_edges(long, ["model", "date"], "value", fwd, min_n=min_n).select("model", "date", "edge")
    per_date = ics.select("model", "date", "ic").join(edges, ["model", "date"])
    dates = calendar(df.select(F.col("date").alias("ts"))).withColumnRenamed("ts", "date")
    size = dates.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))
    per_date = per_date.join(dates, "date").crossJoin(F.broadcast(size))
    cadence = F.when(F.col("day_no") % 4 == 0, F.array(F.lit("all"), F.lit("every_4th"))).otherwise(
        F.array(F.lit("all"))
    )
    window = F.array(
        F.lit("full"), F.when(F.col("day_no") < F.col("_half"), F.lit("early")).otherwise(F.lit("late"))
    )
    rows = per_date.withColumn("cadence", F.explode(cadence)).withColumn("period", F.explode(window))
    return (
        rows.groupBy("cadence", "period", "model")
        .agg(
            F.count("ic").alias("n"),
            F.avg("ic").alias("ic"),
            st.ir("ic", ddof=0).alias("ir"),
            F.avg("edge").alias("edge"),
            st.t_one("edge").alias("t"),
            st.hit("edge").alias("hit"),
        )
        .where(F.col("n") >= min_dates)
    )
