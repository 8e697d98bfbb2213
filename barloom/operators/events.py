"""Event studies: setups, de-overlapping, first-touch exits, sweeps and placebo controls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as st
from ..functions.num import ratio
from .draws import drawn_numbers, numbered_rows
from .series import Series

# fixed values: setup -> (flag, direction)
SETUPS = {
    "sweep_hi": ("s_sweep_hi", -1),
    "sweep_lo": ("s_sweep_lo", 1),
    "breakout_hi": ("s_bo_hi", 1),
    "breakout_lo": ("s_bo_lo", -1),
    "fvg_up": ("s_fvg_up", 1),
    "fvg_dn": ("s_fvg_dn", -1),
    "bos_up": ("s_bos_up", 1),
    "bos_dn": ("s_bos_dn", -1),
    "inside_bar": ("s_inside", 1),
}


def numbered(df: DataFrame, s: Series) -> DataFrame:
    """0-based row number of a series bounded by the calendar."""
    return df.withColumn("pos", F.row_number().over(s.ordered()) - 1)


def setup_rows(df: DataFrame, ids: list[str], setups: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Long form: one row per bar and setup with `hit` (0/1) and `dirn`."""
    setups = setups or SETUPS
    items = F.array(
        *[F.struct(F.lit(n).alias("setup"), F.col(c).alias("hit"), F.lit(d).alias("dirn")) for n, (c, d) in setups.items()]
    )
    return df.select(*ids, F.explode(items).alias("_s")).select(*ids, "_s.setup", "_s.hit", "_s.dirn")


def _next_free(at: np.ndarray, gap: int) -> np.ndarray:
    """For each row the first one at least `gap` positions on; len(at) stands for none, and for itself."""
    return np.append(np.searchsorted(at, at + gap), len(at))


def _last_kept(at: np.ndarray, gap: int) -> np.ndarray:
    """For each row the last one that is kept if the row itself is: steps are doubled until none moves."""
    n = len(at)
    step = _next_free(at, gap)
    last = np.where(step < n, step, np.arange(n + 1))
    while True:
        further = last[last]
        if (further == last).all():
            return last
        last = further


def _kept(at: np.ndarray, gap: int, first: int) -> np.ndarray:
    """All rows kept from row `first` on: the path so far is joined by its image under steps of its own length."""
    n = len(at)
    step, path = _next_free(at, gap), np.array([first])
    while path[-1] < n:
        path = np.concatenate([path, step[path]])
        step = step[step]
    return path[path < n]


def de_overlap(df: DataFrame, keys: list[str], gap: int, pos: str = "pos", block: int = 65_536) -> DataFrame:
    """Greedy: keep a row if it is at least `gap` positions after the last kept one of its key.

    Positions are cut into blocks of `block` (or `gap`, if that is more).  Where the choice begins in a block depends on the blocks
    before only by how far into the block the last gap reaches, so every block makes a table from that to how far its own last gap
    reaches into what follows.  One pass over the tables of a key, one number of state, tells each block where to begin.  No
    task sees more rows than a block has.  Rows without a position are dropped; of rows at one position one is kept.
    """
    if gap < 1:
        raise ValueError("gap must be positive")
    width = max(block, gap)
    df = df.where(F.col(pos).isNotNull()).withColumn("_blk", F.floor(F.col(pos) / F.lit(width)))
    group = [*keys, "_blk"]
    places = df.select(*group, F.col(pos).cast("long").alias("_at"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema.fields)

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["_at"].to_numpy())
        enter = int(pdf["_blk"].iloc[0]) * width + np.arange(gap)
        first = np.searchsorted(at, enter)
        last = _last_kept(at, gap)[first]
        free = np.where(first < len(at), np.append(at, 0)[last] + gap, enter)
        return pdf[group].head(1).assign(_free=[free])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, free = None, 0
        for pdf in batches:
            begin = []
            for mine, blk, table in zip(pdf[keys].itertuples(index=False, name=None) if keys else [()] * len(pdf), pdf["_blk"], pdf["_free"]):
                start = blk * width
                if mine != key:
                    key, free = mine, start
                begin.append(max(free, start))
                free = int(table[begin[-1] - start])
            yield pdf[group].assign(_from=begin)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos, kind="stable")
        at = pdf[pos].to_numpy().astype(np.int64)
        return pdf.iloc[_kept(at, gap, int(np.searchsorted(at, pdf["_from"].iloc[0])))]

    tables = places.groupBy(*group).applyInPandas(table, f"{kinds}, _free array<bigint>")
    tables = tables.repartition(*keys) if keys else tables.coalesce(1)
    starts = tables.sortWithinPartitions(*group).mapInPandas(walk, f"{kinds}, _from bigint")
    found = df.join(starts, group)
    return found.groupBy(*group).applyInPandas(keep, found.schema).select(*df.drop("_blk").columns)


def path_ahead(df: DataFrame, s: Series, n: int) -> DataFrame:
    """Adds `path`: high, low, close of the next n rows.  A bounded frame, so rows never leave their task."""
    return df.withColumn(
        "path", F.collect_list(F.struct("high", "low", "close")).over(s.between(1, n))
    )


def first_touch(
    dirn: Column, entry: Column, risk: Column, rr: Column, path: str = "path"
) -> tuple[Column, Column]:
    """(result in R before costs, bars held).  The stop wins a bar that touches both levels; no touch
    means marked to market at the end of the path.  NULL without a path or risk."""
    stop, target = entry - dirn * risk, entry + dirn * risk * rr

    def touch(x: Column) -> Column:
        hs = F.when(dirn > 0, x["low"] <= stop).otherwise(x["high"] >= stop)
        ht = F.when(dirn > 0, x["high"] >= target).otherwise(x["low"] <= target)
        return F.when(hs, F.lit(-1.0)).when(ht, rr)

    outcomes = F.transform(F.col(path), touch)
    flags = F.transform(outcomes, lambda o: o.isNotNull())
    at = F.array_position(flags, True)
    n = F.size(path)
    timed_out = ratio(dirn * (F.element_at(F.col(path), -1)["close"] - entry), risk)
    result = F.when(at > 0, F.get(outcomes, (at - 1).cast("int"))).otherwise(timed_out)
    ok = (n > 0) & (risk > 0)
    return F.when(ok, result), F.when(ok, F.when(at > 0, at.cast("int")).otherwise(n))


def trade_summary(df: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    out = [
        F.count(r).alias("n"),
        st.hit(r).alias("win"),
        F.avg(r).alias("mean_r"),
        F.sum(r).alias("total_r"),
        st.profit_factor(r).alias("pf"),
        st.t_one(r).alias("t"),
    ]
    return df.groupBy(*by).agg(*out)


def both_ways(df: DataFrame, s: Series, n: int, stop: float, rr: float, cost: float, tail: int) -> DataFrame:
    """A long and a short entry at the close of every row with an `atr` and at least `tail` rows after it: adds dirn, r (after costs) and bars.

    stop and cost are in units of the ATR; the trade ends at the stop, at the target of `rr` times the risk, or after n rows.
    """
    df = path_ahead(df, s, n).withColumn("_after", F.lead(s.ts, tail).over(s.ordered()))
    df = df.where(F.col("_after").isNotNull() & (F.col("atr") > 0)).withColumn("dirn", F.explode(F.array(F.lit(1), F.lit(-1))))
    r, bars = first_touch(F.col("dirn"), F.col("close"), stop * F.col("atr"), F.lit(rr))
    return df.withColumns({"r": r - F.lit(2 * cost / stop), "bars": bars}).drop("path", "_after")


def directional_edge(df: DataFrame, horizons: dict[int, str], min_events: int = 12) -> DataFrame:
    """Welch test of directed forward returns after a setup against all other rows, both
    de-overlapped by the horizon, per symbol and setup."""
    parts = []
    for h, fwd in horizons.items():
        rows = setup_rows(df.where(F.col(fwd).isNotNull()), ["symbol", "pos", fwd])
        kept = de_overlap(rows, ["symbol", "setup", "hit"], h)
        x = F.col("dirn") * F.col(fwd)
        a, b = F.when(F.col("hit") == 1, x), F.when(F.col("hit") == 0, x)
        t, dof = st.welch(a, b)
        parts.append(
            kept.groupBy("symbol", "setup").agg(
                F.lit(h).alias("h"),
                F.count(a).alias("n"),
                F.avg(a).alias("event_mean"),
                F.avg(b).alias("base_mean"),
                t.alias("t"),
                dof.alias("dof"),
            )
        )
    return reduce(lambda p, r: p.unionByName(r), parts).where(F.col("n") >= min_events)


def placebo(
    outcomes: DataFrame, by: list[str], n: DataFrame, reps: int, seed: int, value: str, row_id: str
) -> DataFrame:
    """Means of `reps` random draws of n rows per group, without replacement.

    Outcomes are known per row, so a replicate is only a choice of rows.  Rows of a group are numbered once; draw k of a
    replicate is the image of k under a permutation of the numbers keyed by (seed, replicate, group), joined to its row.
    The cost is that of the rows drawn, replicates x n, whatever the size of the groups.  Draws depend on seed, replicate
    and row ids alone, not on the partitioning.  Rows without a value are not drawn; a group with fewer than n rows gives all of them.
    n: (by, n), one row per group.
    """
    full = outcomes.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.col(row_id).alias("_id"))
    plan = n.select(*by, "n").join(full.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")), by)
    rows = numbered_rows(full.join(plan, by), by, "_size", ["_id", "_v"]).select(*by, "_no", "_v")
    draws = drawn_numbers(plan, by, "n", "_size", reps, seed)
    return draws.join(rows, [*by, "_no"]).groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("drawn"), F.avg("_v").alias("mean"))


def against_placebo(actual: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """Percentile of the actual mean among the draws, and the verdict."""
    dist = draws.groupBy(*by).agg(
        F.avg("mean").alias("random_mean"),
        F.percentile("mean", F.lit(0.05)).alias("p05"),
        F.percentile("mean", F.lit(0.95)).alias("p95"),
    )
    below = (
        draws.join(actual.select(*by, F.col("mean").alias("_a")), by)
        .groupBy(*by)
        .agg((F.avg(F.when(F.col("mean") < F.col("_a"), 1.0).otherwise(0.0)) * 100).alias("percentile"))
    )
    verdict = F.when(F.col("percentile") > 95, "beats random").when(
        F.col("percentile") > 5, "indistinguishable"
    ).otherwise("worse")
    return actual.join(dist, by).join(below, by).withColumn("verdict", verdict)


def multiple_tests(results: DataFrame, t: str, alpha: float = 0.05, raw_t: float = 1.96) -> DataFrame:
    """How many tests ran, hit at a raw threshold, would by chance, and the corrected threshold."""
    return results.agg(
        F.count(t).alias("tests"),
        F.count_if(F.abs(t) > raw_t).alias("raw_hits"),
        (F.count(t) * alpha).alias("expected_hits"),
        st.bonferroni(F.count(t), alpha).alias("bonferroni_p"),
    )


def survivors(results: DataFrame, t: str, n: str, alpha: float = 0.05) -> DataFrame:
    """The rows whose two-sided p-value passes the threshold corrected for the number of tests, smallest first.

    results holds one row per test; its count is a one-row aggregate, and p is computed per test, never per data row.
    """
    total = F.broadcast(results.agg(st.bonferroni(F.count(t), alpha).alias("bonferroni_p")))
    tested = results.withColumn("p", st.t_pvalue(t, (F.col(n) - 1).cast("double")))
    return tested.crossJoin(total).where(F.col("p") < F.col("bonferroni_p")).orderBy("p")
