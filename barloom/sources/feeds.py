"""Readers, feed normalisation and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.num import clean

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)
# fixed values: column names of the exported bars, the ticks and the grouped feed
BARS_SPREAD = T.StructType(
    [
        T.StructField("dt", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("tick_volume", T.LongType()),
        T.StructField("spread", T.IntegerType()),
    ]
)
TICKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
    ]
)
FEED = "o double, h double, l double, c double, v double, vw double, n long, t long"
POINT = 0.001  # fixed value: dollars per spread point


def read_panel(
    spark: SparkSession,
    path: str,
    symbols: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    interval: str | None = None,
) -> DataFrame:
    """Bars of any interval from parquet; filters and columns reach the scan."""
    df = spark.read.parquet(path)
    if interval is not None and "interval" in df.columns:
        df = df.where(F.col("interval") == interval)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return df.select(
        "symbol", "ts", *[clean(c).alias(c) for c in ("open", "high", "low", "close", "volume")]
    )


def read_bars_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Broker export with UTC `dt` and spread in points; adds the spread in dollars."""
    raw = spark.read.schema(BARS_SPREAD).option("header", True).csv(path)
    return raw.select(
        F.lit(symbol).alias("symbol"),
        F.col("dt").alias("ts"),
        *[clean(c).alias(c) for c in ("open", "high", "low", "close")],
        F.col("tick_volume").cast("double").alias("volume"),
        points_to_dollars(F.col("spread")).alias("spread_usd"),
    )


def points_to_dollars(points: Column) -> Column:
    return points * F.lit(POINT)


def normalise_feed(raw: DataFrame, value: str = "value") -> DataFrame:
    """Grouped-day JSON rows -> bars with vwap (close where the feed has none); no price, no row."""
    # the feed has both `T` and `t`, which only differ in case
    name = F.get_json_object(value, "$.T").alias("symbol")
    r = raw.select(name, F.from_json(value, FEED).alias("r")).select("symbol", "r.*")
    bars = r.select(
        "symbol",
        F.timestamp_millis("t").alias("ts"),
        clean("o").alias("open"),
        clean("h").alias("high"),
        clean("l").alias("low"),
        clean("c").alias("close"),
        clean("v").alias("volume"),
        F.coalesce(clean("vw"), clean("c")).alias("vwap"),
        F.col("n").alias("trades"),
    )
    return bars.dropna(subset=["open", "high", "low", "close", "volume"])


def short_symbol(c: Column) -> Column:
    """Display name: feed prefix and quote currency removed."""
    return F.regexp_replace(F.regexp_replace(c, "^X:", ""), "USD$", "")


def union_panels(*panels: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), panels)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key in `order`.  max_by combines map-side, so a hot key costs a row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def merge_pulls(*pulls: DataFrame) -> DataFrame:
    """Overlapping chunk pulls -> one row per (symbol, ts): that of the earliest pull, in the order given."""
    numbered = union_panels(*[p.withColumn("_pull", F.lit(i)) for i, p in enumerate(pulls)])
    rest = [c for c in numbered.columns if c not in ("symbol", "ts", "_pull")]
    first = numbered.groupBy("symbol", "ts").agg(F.min_by(F.struct(*rest), F.struct("_pull", *rest)).alias("_row"))
    return first.select("symbol", "ts", "_row.*")


# ── sinks ────────────────────────────────────────────────────────────────────
def write_panel(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> None:
    """Scored panel by date, so that a date range prunes directories."""
    df.repartition(date).write.mode(mode).partitionBy(date).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result tables: hourly volatility profile, feature scan, ranked report."""
    df.write.mode(mode).parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def last_events(history: DataFrame, n: int = 20, per: list[str] | None = None) -> DataFrame:
    """Bounded view of the signal history: the newest n, overall or per key."""
    newest = [F.col("ts").desc(), F.col("symbol"), F.col("event")]
    if per is None:
        return history.orderBy(*newest).limit(n)
    w = Window.partitionBy(*per).orderBy(*newest)
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
