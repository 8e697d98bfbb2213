"""How an ordered series is laid out for window operators.

Two layouts, one API.  `Series.part` / `Series.order` are what every window operator uses, so the
same operator code runs on either:

* plain: PARTITION BY symbol.  Right when a series is bounded by the calendar: bars at an hour or
  coarser are unique per (symbol, bar), so even a century of hourly bars is under 900k rows and a
  hot symbol cannot exist after bars are built.
* blocked: for minutes, ticks or anything unbounded.  Every row gets its exact 0-based position in
  its series, positions are cut into blocks of `block_rows`, and each block also receives the last
  `back` rows of the block before it (and the first `ahead` rows of the block after).  A window of
  bounded reach is then exact inside one block, and one symbol spreads over as many tasks as it
  has blocks.  `keep_own` drops the borrowed rows again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
#: Rows that a task gets of a table that is dealt by key: the wide windows of a panel hold some 2 KB a row.
TASK_ROWS = 100_000
BUCKET_SECONDS = 30 * 86_400
SEGMENTS = (10_000, 1_000)  # rows; each divides the one before


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    part: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    index: str | None = None  # 0-based row index, once the series is segmented

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, -1)

    def last(self, n: int) -> WindowSpec:
        return self.ordered().rowsBetween(-(n - 1), 0)

    def between(self, lo: int, hi: int) -> WindowSpec:
        return self.ordered().rowsBetween(lo, hi)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.part)


def plain(*keys: str, ts: str = "ts") -> Series:
    keys = keys or ("symbol",)
    return Series(keys=keys, ts=ts, part=keys, order=(ts,))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` of about `rows` rows dealt by key to tasks of about TASK_ROWS rows.

    A fixed number of partitions, or one that AQE joins up to the number of cores, gives tasks that grow with the table; what their sorts
    cannot hold is spilled.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return df.repartition(tasks, *keys)


def segmented(df: DataFrame, s: Series) -> tuple[DataFrame, Series]:
    """Number the rows and cut them into nested segments, for exponential averages.

    The segment numbers lead the sort order.  They grow with time, so every window still sees its
    rows in time order, and windows per symbol, per long segment and per short segment all share
    one sort.
    """
    if s.index is not None:
        return df, s
    df = df.withColumn("_i", F.row_number().over(s.ordered()) - 1)
    return _with_segments(df, s, "_i", s.order)


def _with_segments(df: DataFrame, s: Series, index: str, order: tuple[str, ...]) -> tuple[DataFrame, Series]:
    df = df.withColumns({f"_s{n}": F.floor(F.col(index) / F.lit(n)) for n in SEGMENTS})
    return df, replace(s, order=(*[f"_s{n}" for n in SEGMENTS], *order), index=index)


def plainly(df: DataFrame) -> DataFrame:
    """Drop the helper columns of `segmented`."""
    return df.drop("_i", *[f"_s{n}" for n in SEGMENTS])


def time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(int(seconds)))


def with_position(
    df: DataFrame,
    keys: tuple[str, ...],
    order: list[Column | str],
    bucket: Column,
    out: str = "_pos",
) -> DataFrame:
    """Exact 0-based row position per key, without a whole key in one task.

    `bucket` must never decrease along `order`.  Rows are counted per (key, bucket) with map-side
    combine, the small count table is prefix-summed, and only the rank inside a bucket needs the
    rows themselves.
    """
    df = df.withColumn("_bkt", bucket)
    counts = df.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_bkt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_bkt"])
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .drop("_bkt", "_rn", "_off")
    )


def split(
    df: DataFrame,
    series: Series,
    back: int,
    ahead: int = 0,
    block_rows: int = BLOCK_ROWS,
    bucket_seconds: int = BUCKET_SECONDS,
) -> tuple[DataFrame, Series]:
    """Blocked layout: adds `_pos`, `_blk`, `_own`; borrowed rows have `_own` false."""
    if back > block_rows or ahead > block_rows:
        raise ValueError("reach of the windows must not exceed block_rows")
    df = with_position(df, series.keys, [series.ts], time_bucket(series.ts, bucket_seconds))
    home = F.floor(F.col("_pos") / F.lit(block_rows))
    spots = [F.struct(home.alias("blk"), F.lit(True).alias("own"))]
    if back:
        nxt = F.floor((F.col("_pos") + F.lit(back)) / F.lit(block_rows))
        spots.append(F.when(nxt > home, F.struct(nxt.alias("blk"), F.lit(False).alias("own"))))
    if ahead:
        prv = F.floor((F.col("_pos") - F.lit(ahead)) / F.lit(block_rows))
        spots.append(
            F.when((prv < home) & (prv >= 0), F.struct(prv.alias("blk"), F.lit(False).alias("own")))
        )
    df = (
        df.withColumn("_at", F.explode(F.array_compact(F.array(*spots))))
        .withColumn("_blk", F.col("_at.blk"))
        .withColumn("_own", F.col("_at.own"))
        .drop("_at")
    )
    blocked = replace(series, part=(*series.keys, "_blk"), order=("_pos",))
    return _with_segments(df, blocked, "_pos", ("_pos",))


def keep_own(df: DataFrame) -> DataFrame:
    return plainly(df.where("_own").drop("_blk", "_own", "_pos"))
