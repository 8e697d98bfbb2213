"""A scored panel that grows by days: new bars are scored from the tails and averages of a snapshot, not from the history.

    <path>/panel/date=<day>/        scored rows
    <path>/state/asof=<day>/        per symbol: the last TAIL bars, the averages after the last one, how many bars came before

Extending overwrites the partitions of the new days only.  It starts from the newest snapshot before the first new day, so the
same days can be run again after a failure or a correction, with the same result.

Bars are written once, dealt by symbol to PARTS, and scored one slice of the parts after another.  Wide rows of one slice only are on disk at a time
besides the panel itself; they are shuffled to their days and never checkpointed.  Days are swapped in when all slices are written.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import technical
from ..operators.universe import complete
from .panels import AVERAGES, SIGNAL, TAIL, indicator_panel

#: Symbols are dealt by hash to so many parts; parts are scored together while they hold at most SLICE_ROWS rows.
PARTS = 16
SLICE_ROWS = 4_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BAR = ("ts", "open", "high", "low", "close", "volume")
_STATE = (*AVERAGES, *SIGNAL)


def _day(column: str = "ts"):
    return F.to_date(column)


def _snapshot(rows: DataFrame) -> DataFrame:
    """Tails, averages and counts from rows of an indicator panel that end with the newest bar of each symbol."""
    last = rows.where(F.col("_left") < TAIL)
    bar = F.struct(*_BAR)
    head = F.max_by(F.struct(*_STATE, F.col("row_no").alias("rows")), "ts")
    return last.groupBy("symbol").agg(F.sort_array(F.collect_list(bar)).alias("tail"), head.alias("head")).select("symbol", "tail", "head.*")


def _files(spark: SparkSession, path: str):
    """The path maker and the file system of `path`."""
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path, jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def _scratch(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside the panel, deleted at the end; until then a job's shuffle files go when the job ends, not when the driver collects garbage."""
    folder, was = f"{path}/_new-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield folder
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)
        at, fs = _files(spark, path)
        fs.delete(at(folder), True)


def _part():
    return F.pmod(F.xxhash64("symbol"), F.lit(PARTS)).cast("int")


def _staged(bars: DataFrame, folder: str) -> DataFrame:
    """`bars` written once, by part, so that a slice reads its own files only."""
    dealt = bars.withColumn("_part", _part())
    dealt.write.option("compression", "zstd").partitionBy("_part").parquet(folder)
    return bars.sparkSession.read.schema(dealt.schema).parquet(folder)


def _slices(rows: DataFrame) -> Iterator[DataFrame]:
    """Staged rows in slices of whole symbols."""
    sizes = rows.groupBy("_part").count().orderBy("_part").collect()
    slices: list[list[int]] = []
    held = 0
    for part, n in sizes:
        if not slices or held + n > SLICE_ROWS:
            slices.append([])
            held = 0
        slices[-1].append(part)
        held += n
    for parts in slices:
        yield rows.where(F.col("_part").isin(parts)).drop("_part")


def _write_panel(rows: DataFrame, folder: str, min_rows: int) -> None:
    kept = rows.where(F.col("row_no") >= min_rows).drop("_fast", "_slow", "_signal", "_left").withColumn("date", _day())
    # files of even size, so a day with very many symbols is shared by tasks; rows are scored where they are written, which keeps scores out of the shuffle
    scored = technical.add_scores(technical.with_defaults(kept.hint("rebalance", "date")))
    scored.write.mode("append").option("compression", "zstd").partitionBy("date").parquet(folder)


def _write_state(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def _publish(spark: SparkSession, folder: str, path: str, asof: dt.date | None) -> None:
    """Swap in the days of the panel, then the snapshot."""
    at, fs = _files(spark, path)

    def swap(new, old) -> None:
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"could not rename {new} to {old}")

    panel, state = at(f"{path}/panel"), at(f"{path}/state")
    fs.mkdirs(panel)
    scored = at(f"{folder}/panel")
    for f in fs.listStatus(scored) if fs.exists(scored) else []:
        swap(f.getPath(), at(panel, f.getPath().getName()))
    if asof is not None:
        fs.mkdirs(state)
        swap(at(f"{folder}/state"), at(state, f"asof={asof.isoformat()}"))


def start(bars: DataFrame, path: str, min_rows: int = technical.MIN_ROWS) -> None:
    """Score the whole history and write the first snapshot.  bars: symbol, ts, open, high, low, close, volume."""
    spark = bars.sparkSession
    with _scratch(spark, path) as folder:
        new = _staged(complete(bars.select("symbol", *_BAR)), f"{folder}/bars")
        newest = new.agg(F.max(_day())).first()[0]
        for own in _slices(new):
            rows = indicator_panel(own, with_state=True)
            _write_panel(rows, f"{folder}/panel", min_rows)
            _write_state(_snapshot(rows), f"{folder}/state")
        _publish(spark, folder, path, newest)


def state(spark: SparkSession, path: str, before: dt.date) -> DataFrame | None:
    """The newest snapshot of a day before `before`."""
    at, fs = _files(spark, path)
    top = at(f"{path}/state")
    found = fs.listStatus(top) if fs.exists(top) else []
    days = [dt.date.fromisoformat(f.getPath().getName().removeprefix("asof=")) for f in found if fs.exists(at(f.getPath(), "_SUCCESS"))]
    days = [d for d in days if d < before]
    return spark.read.parquet(f"{path}/state/asof={max(days).isoformat()}") if days else None


def extend(bars: DataFrame, path: str, min_rows: int = technical.MIN_ROWS) -> None:
    """Score the bars of new days and move the snapshot on.  `bars` must hold whole days, all of them after some snapshot.

    Reads the snapshot and the new bars; symbols without new bars keep their tail, new symbols start their history.
    """
    spark = bars.sparkSession
    with _scratch(spark, path) as folder:
        new = _staged(complete(bars.select("symbol", *_BAR)), f"{folder}/bars")
        first, newest = new.agg(F.min(_day()), F.max(_day())).first()
        if first is None:
            return
        held = state(spark, path, first)
        if held is None:
            raise ValueError(f"no snapshot before {first} in {path}: call start")
        active = held.join(new.select("symbol").distinct(), "symbol", "left_semi")
        size = F.size("tail")
        old = active.select("symbol", F.posexplode("tail").alias("_i", "_b"), (F.col("rows") - size).alias("_before"), size.alias("_n"), F.struct(*_STATE).alias("_held"))
        old = old.select("symbol", "_b.*", F.lit(True).alias("_old"), "_before", F.when(F.col("_i") == F.col("_n") - 1, F.col("_held")).alias("_held"))
        old = _staged(old, f"{folder}/tails")
        both = old.unionByName(new.withColumn("_old", F.lit(False)), allowMissingColumns=True)
        whole = Window.partitionBy("symbol")
        for own in _slices(both):
            rows = indicator_panel(own, carried="_held", with_state=True)
            rows = rows.withColumn("row_no", F.col("row_no") + F.coalesce(F.max("_before").over(whole), F.lit(0))).drop("_before", "_held")
            _write_panel(rows.where(~F.col("_old")).drop("_old"), f"{folder}/panel", min_rows)
            _write_state(_snapshot(rows), f"{folder}/state")
        _write_state(held.join(new.select("symbol").distinct(), "symbol", "left_anti"), f"{folder}/state")
        _publish(spark, folder, path, newest)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/panel")
