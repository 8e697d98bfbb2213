"""Cross-sectional operators: z-scores, ranks, quintiles, rank IC and decile edges per date.

A date can hold any share of the rows.  Means and deviations are aggregates joined back.  Ranks window over a date only if every
date fits a task (LARGE_GROUP rows, counted first); else they come from counts of distinct values per coarse value bucket
(ties collapse map-side), prefix-summed in two steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clamp, non_null_mean, ratio
from ..functions.stats import pearson
from .series import dealt

RUN = (Window.unboundedPreceding, -1)
#: Rows of a group that one task may sort: a few narrow columns each, some 100 MB a sort.
LARGE_GROUP = 1_000_000
#: Buckets of values that a large group is cut into.
VALUE_BUCKETS = 256


def zscores(
    df: DataFrame,
    cols: list[str],
    by: str = "ts",
    clip: float | None = 3.0,
    flat: float | None = None,
) -> DataFrame:
    """`<col>_z` per group of `by`; a group with no spread gives `flat` (NULL by default)."""
    stats = df.groupBy(by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"_d_{c}") for c in cols]
    )
    # a row per date: rows stay where they are
    df = df.join(F.broadcast(stats), by)
    out = {}
    for c in cols:
        z = ratio(F.col(c) - F.col(f"_m_{c}"), f"_d_{c}")
        if flat is not None:
            z = F.when(F.coalesce(F.col(f"_d_{c}"), F.lit(0.0)) == 0, F.lit(flat)).otherwise(z)
        out[f"{c}_z"] = clamp(z, -clip, clip) if clip else z
    return df.withColumns(out).drop(*[f"_m_{c}" for c in cols], *[f"_d_{c}" for c in cols])


def equal_weight(df: DataFrame, cols: list[str], out: str = "score") -> DataFrame:
    return df.withColumn(out, non_null_mean(*[F.col(c) for c in cols]))


def _starts(df: DataFrame, by: list[str], value: str, extra: list[str]) -> DataFrame:
    """(by, value, extra) -> `_start` rows sorting before it in its group, and `_cnt`.

    Values are counted first, then cut at quantiles of the distinct values of their group, so that neither a narrow nor a wide
    range of values, nor a value that very many rows share, makes an uneven bucket.
    """
    c = df.groupBy(*by, value, *extra).agg(F.count(F.lit(1)).alias("_cnt"))
    at = F.array(*[F.lit(i / VALUE_BUCKETS) for i in range(1, VALUE_BUCKETS)])
    cuts = c.groupBy(*by).agg(F.percentile_approx(value, at, 20 * VALUE_BUCKETS).alias("_q"))
    c = c.join(cuts, by).withColumn("_vb", F.size(F.filter("_q", lambda x: x < F.col(value)))).drop("_q")
    per_bucket = c.groupBy(*by, "_vb").agg(F.sum("_cnt").alias("_bn"))
    over_buckets = Window.partitionBy(*by).orderBy("_vb").rowsBetween(*RUN)
    per_bucket = per_bucket.select(
        *by, "_vb", F.coalesce(F.sum("_bn").over(over_buckets), F.lit(0)).alias("_boff")
    )
    inside = Window.partitionBy(*by, "_vb").orderBy(value, *extra).rowsBetween(*RUN)
    return (
        c.withColumn("_in", F.coalesce(F.sum("_cnt").over(inside), F.lit(0)))
        .join(per_bucket, [*by, "_vb"])
        .select(*by, value, *extra, (F.col("_boff") + F.col("_in")).alias("_start"), "_cnt")
    )


def has_large(df: DataFrame, by: list[str], limit: int = LARGE_GROUP) -> bool:
    """Whether any group is too large to be sorted in one task (counts combine map-side)."""
    return not df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).isEmpty()


def group_sizes(df: DataFrame, by: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups (counts combine map-side)."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    largest, rows = n.agg(F.max("_n"), F.sum("_n")).first()
    return largest or 0, rows or 0


def average_rank(
    df: DataFrame, by: list[str], value: str, out: str, large: bool | None = None
) -> DataFrame:
    """1-based rank with ties averaged; rows with a NULL value are dropped.

    Groups that fit a task are ranked by one window.  If a group is large (looked up unless the caller knows), ranks come from
    counts of distinct values per value bucket instead, with the same result.
    """
    df = df.where(F.col(value).isNotNull())
    if not (has_large(df, by) if large is None else large):
        w = Window.partitionBy(*by).orderBy(value)
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2)
    starts = _starts(df, by, value, [])
    return (
        df.join(starts, [*by, value])
        .withColumn(out, F.col("_start") + (F.col("_cnt") + 1) / 2)
        .drop("_start", "_cnt")
    )


def ordinal_rank(
    df: DataFrame,
    by: list[str],
    value: str,
    tie: str,
    out: str = "r",
    descending: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """1-based rank with ties in order of `tie`; in large groups equal values split further by the start of `tie`."""
    df = df.where(F.col(value).isNotNull())
    if not (has_large(df, by) if large is None else large):
        first = F.col(value).desc() if descending else F.col(value).asc()
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(first, F.col(tie).cast("string"))))
    df = df.withColumns(
        {
            "_v": -F.col(value) if descending else F.col(value),
            "_tp": F.substring(F.col(tie).cast("string"), 1, 4),
        }
    )
    starts = _starts(df, by, "_v", ["_tp"])
    ties = Window.partitionBy(*by, "_v", "_tp").orderBy(F.col(tie).cast("string"))
    return (
        df.withColumn("_t", F.row_number().over(ties))
        .join(starts, [*by, "_v", "_tp"])
        .withColumn(out, F.col("_start") + F.col("_t"))
        .drop("_v", "_tp", "_t", "_start", "_cnt")
    )


def with_count(df: DataFrame, by: list[str], out: str = "n") -> DataFrame:
    """Rows of its group next to every row; nothing is sorted, and counts combine map-side."""
    return df.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias(out)), by)


def quantile_of_rank(r: Column, n: Column, q: int = 5) -> Column:
    """0-based quantile of a first-rank: edges interpolated on the ranks, right edge included."""
    edge = F.ceil(ratio((r - 1) * F.lit(float(q)), n - 1)) - 1
    return F.greatest(F.coalesce(edge, F.lit(0)), F.lit(0))


def quintiles(df: DataFrame, by: str, score: str, tie: str = "symbol", q: int = 5) -> DataFrame:
    df = df.where(F.col(score).isNotNull() & F.col(by).isNotNull())
    large = has_large(df, [by])
    df = ordinal_rank(df, [by], score, tie, "_r", large=large)
    if large:
        df = with_count(df, [by], "_n")
    else:
        df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    return df.withColumn("q", quantile_of_rank(F.col("_r"), F.col("_n"), q).cast("int")).drop("_r", "_n")


def decile_size(n: Column, frac: float = 0.1) -> Column:
    """Half-even rounding of frac*n, at least one."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(frac)).cast("int"))


def decile_edges(
    df: DataFrame, by: list[str], score: str, fwd: str, tie: str = "symbol", min_n: int = 20
) -> DataFrame:
    """Per group: mean forward return of top and bottom decile and of all, edge and spread."""
    df = df.where(F.col(score).isNotNull() & F.col(fwd).isNotNull())
    large = has_large(df, by)
    df = ordinal_rank(df, by, score, tie, "_hi", descending=True, large=large)
    df = ordinal_rank(df, by, score, tie, "_lo", large=large)
    if large:
        df = with_count(df, by, "_n")
    else:
        df = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    df = df.where(F.col("_n") >= min_n)
    k = decile_size(F.col("_n"))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("_hi") <= k, F.col(fwd))).alias("top"),
        F.avg(F.when(F.col("_lo") <= k, F.col(fwd))).alias("bot"),
        F.avg(fwd).alias("uni"),
    )
    return out.withColumns(
        {"edge": F.col("top") - F.col("uni"), "spread": F.col("top") - F.col("bot")}
    )


def rank_ic(
    df: DataFrame,
    by: list[str],
    feature: str,
    fwd: str,
    more_than: int = 10,
    distinct_over: int = 3,
) -> DataFrame:
    """Spearman correlation per group, for groups with enough rows and distinct values."""
    return rank_ics(df, by, feature, [fwd], more_than, distinct_over).drop("horizon")


def rank_ics(
    df: DataFrame, by: list[str], feature: str, fwds: list[str], more_than: int = 10, distinct_over: int = 3
) -> DataFrame:
    """`rank_ic` against several forward returns, told apart by `horizon`; rows move once for all of them.

    A forward return ranks the rows that have it.  These are counted along the values of the feature, so one sort serves every horizon.
    """
    df = df.where(F.col(feature).isNotNull()).select(*by, feature, *fwds)
    largest, rows = group_sizes(df, by)
    if largest > LARGE_GROUP:
        parts = [_large_rank_ic(df, by, feature, x, more_than, distinct_over).withColumn("horizon", F.lit(x)) for x in fwds]
        return reduce(lambda a, b: a.unionByName(b), parts)
    df = dealt(df, rows, *by)
    now, upto = (Window.currentRow, Window.currentRow), (Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy(*by).orderBy(feature)
    found = {}
    for i, x in enumerate(fwds):
        found |= {
            f"_le{i}": F.count(x).over(w.rangeBetween(*upto)),
            f"_eq{i}": F.count(x).over(w.rangeBetween(*now)),
            f"_no{i}": F.count(x).over(w.rowsBetween(*upto)),
        }
    df = df.withColumns(found)
    of = []
    for i, x in enumerate(fwds):
        y = Window.partitionBy(*by).orderBy(x)
        known, le, eq = F.col(x).isNotNull(), F.col(f"_le{i}"), F.col(f"_eq{i}")
        ry = F.count(x).over(y.rangeBetween(*upto)) - (F.count(x).over(y.rangeBetween(*now)) - 1) / 2
        # the first row of each distinct value that has a return
        opens = known & (F.col(f"_no{i}") == le - eq + 1)
        df = df.withColumns({f"_rx{i}": F.when(known, le - (eq - 1) / 2), f"_ry{i}": F.when(known, ry), f"_nd{i}": opens.cast("int")})
        df = df.drop(f"_le{i}", f"_eq{i}", f"_no{i}")
        of += [F.count(x).alias(f"_n{i}"), F.sum(f"_nd{i}").alias(f"_nd{i}"), pearson(f"_rx{i}", f"_ry{i}").alias(f"_ic{i}")]
    each = [
        F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_nd{i}").alias("_nd"), F.col(f"_ic{i}").alias("ic"), F.lit(x).alias("horizon"))
        for i, x in enumerate(fwds)
    ]
    out = df.groupBy(*by).agg(*of).select(*by, F.inline(F.array(*each)))
    return out.where((F.col("n") > more_than) & (F.col("_nd") > distinct_over) & F.col("ic").isNotNull()).drop("_nd")


def _large_rank_ic(df: DataFrame, by: list[str], feature: str, fwd: str, more_than: int, distinct_over: int) -> DataFrame:
    """One horizon of `rank_ics` where a group is more than a task may sort."""
    df = df.where(F.col(fwd).isNotNull()).select(*by, feature, fwd)
    df = average_rank(df, by, feature, "_rx", True)
    df = average_rank(df, by, fwd, "_ry", True)
    return (
        df.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct(F.col(feature)).alias("_nd"),
            pearson("_rx", "_ry").alias("ic"),
        )
        .where((F.col("n") > more_than) & (F.col("_nd") > distinct_over) & F.col("ic").isNotNull())
        .drop("_nd")
    )


# ── picks ────────────────────────────────────────────────────────────────────
def top_n(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First n rows in `order` with their rank: each task keeps n rows, then one merge."""
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sector_capped_top(
    df: DataFrame, n: int, score: str = "total", sector: str = "sector", cap: int = 3,
    tradeable: str | None = None, tie: str = "symbol",
) -> DataFrame:
    """Best n with at most `cap` per sector, filled up from the rest only if too few are left.

    A row with n better rows in its own sector can never be picked, so each sector is cut to n
    rows first (a limit Spark applies per task before it shuffles): a hot sector stays small.
    """
    gate = [F.col(tradeable).cast("int").desc()] if tradeable else []
    order = [*gate, F.col(score).desc(), F.col(tie)]
    in_sector = Window.partitionBy(sector).orderBy(*order)
    few = df.withColumn("sector_rank", F.row_number().over(in_sector)).where(
        F.col("sector_rank") <= max(n, cap)
    )
    return top_n(few, n, F.col("sector_rank") > cap, *order)


def latest_extremes(
    df: DataFrame, n: int, score: str = "score", ts: str = "ts", exclude: tuple[str, ...] = ()
) -> DataFrame:
    """Top n (`side` long) and bottom n (`side` short) on the last date, benchmark left out."""
    last = df.agg(F.max(ts).alias(ts))
    cur = df.join(F.broadcast(last), ts, "left_semi").where(F.col(score).isNotNull())
    if exclude:
        cur = cur.where(~F.col("symbol").isin(*exclude))
    longs = top_n(cur, n, F.col(score).desc(), F.col("symbol")).withColumn("side", F.lit("long"))
    shorts = top_n(cur, n, F.col(score), F.col("symbol")).withColumn("side", F.lit("short"))
    return longs.unionByName(shorts)


def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Distinct dates with their 0-based number.

    One row per date, so bounded by the calendar: bars finer than a day are refused, their times are not numbered in one task.
    """
    finer = F.date_trunc("day", F.col(ts).cast("timestamp")) != F.col(ts).cast("timestamp")
    dates = df.select(ts).distinct().select(F.when(finer, F.raise_error(F.lit("calendar() numbers days; this column is finer"))).otherwise(F.col(ts)).alias(ts))
    return dates.withColumn("day_no", F.row_number().over(Window.orderBy(ts)) - 1)


def rebalance_dates(df: DataFrame, warmup: int, max_h: int, step: int, ts: str = "ts") -> DataFrame:
    """Every step-th date after the warm-up, stopping max_h + 1 dates before the end."""
    cal = calendar(df, ts)
    size = cal.agg(F.count(F.lit(1)).alias("_size"))
    return (
        cal.crossJoin(F.broadcast(size))
        .where(
            (F.col("day_no") >= warmup)
            & (F.col("day_no") < F.col("_size") - max_h - 1)
            & ((F.col("day_no") - warmup) % step == 0)
        )
        .select(ts, "day_no")
    )


def middle_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: the date in the middle of the distinct dates (upper middle for even counts)."""
    cal = calendar(df, ts)
    size = cal.agg(F.floor(F.count(F.lit(1)) / 2).alias("_half"))
    return cal.crossJoin(F.broadcast(size)).where(F.col("day_no") == F.col("_half")).select(
        F.col(ts).alias("split")
    )
