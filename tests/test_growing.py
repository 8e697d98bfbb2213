"""The growing panel on disk: slices of symbols, no wide rows besides the panel, no files left behind."""

from __future__ import annotations

import datetime as dt
import pathlib
import time

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans import growing, panels

START = dt.datetime(2020, 1, 1)


def bars_of(spark, lengths, shift=0.0):
    """Symbols of so many daily bars that end on the same day, one bar without a price, one symbol without a name."""
    rows, last = [], max(lengths)
    for k, n in enumerate(lengths):
        for i in range(last - n, last):
            p = 50 + k + (i * (7 + k)) % 11 - 0.1 * (i % 17) + shift
            rows.append((f"S{k}" if k else None, START + dt.timedelta(days=i), p, p + 1 + i % 3, p - 1 - i % 2, p + (i * 5) % 7 / 10, 100.0 + i % 13))
    rows.append(("S1", START + dt.timedelta(days=last - 1, hours=1), 1.0, None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def rounded(df: DataFrame, columns: list[str]) -> list[tuple]:
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()), key=str)


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def folders(path) -> list[str]:
    return sorted(p.name for p in pathlib.Path(path).iterdir())


def test_slices_leave_the_panel_and_the_snapshot_only(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("wide rows are checkpointed")

    for name in ("checkpoint", "localCheckpoint", "persist", "cache"):
        monkeypatch.setattr(type(spark.range(1)), name, refuse)
    monkeypatch.setattr(growing, "SLICE_ROWS", 50, raising=False)
    bars, path = bars_of(spark, [40, 40, 38, 35, 3]), str(tmp_path)
    cut = F.lit(START + dt.timedelta(days=30))
    was, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    growing.start(bars.where(F.col("ts") < cut), path, min_rows=2)
    growing.extend(bars.where((F.col("ts") >= cut) & F.col("symbol").isNotNull()), path, min_rows=2)
    assert folders(tmp_path) == ["panel", "state"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    until = time.time() + 20
    while (left := shuffle_files(spark) - was) and time.time() < until:
        time.sleep(0.5)
    assert not left
    whole = panels.technical_panel(bars, min_rows=2).where((F.col("ts") < cut) | F.col("symbol").isNotNull())
    assert rounded(growing.read(spark, path), whole.columns) == rounded(whole, whole.columns)
    held = growing.state(spark, path, dt.date(2030, 1, 1)).collect()
    assert {r.symbol: (len(r.tail), r.rows) for r in held} == {None: (30, 30), "S1": (40, 40), "S2": (38, 38), "S3": (35, 35), "S4": (3, 3)}


def test_slices_are_whole_symbols_of_so_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "SLICE_ROWS", 100)
    bars = bars_of(spark, [10 + k for k in range(30)])
    got = [sorted(r.symbol or "" for r in s.select("symbol").collect()) for s in growing._slices(growing._staged(bars, f"{tmp_path}/bars"))]
    assert sorted(x for s in got for x in s) == sorted(r.symbol or "" for r in bars.select("symbol").collect())
    assert sum(len(set(s)) for s in got) == 30 and len(got) > 5
    # a part may hold more than a slice should, then it is a slice of its own
    parts = [{r._part for r in spark.createDataFrame([(x,) for x in s if x], "symbol string").select(growing._part().alias("_part")).collect()} for s in got]
    assert all(len(s) <= 100 or len(p) == 1 for s, p in zip(got, parts))


def test_a_run_that_fails_between_slices_changes_nothing(spark, tmp_path, monkeypatch):
    path, cut = str(tmp_path), F.lit(START + dt.timedelta(days=8))
    first, fixed = bars_of(spark, [3, 10, 10, 9]).where("symbol IS NOT NULL"), bars_of(spark, [3, 10, 10, 9], 5.0).where("symbol IS NOT NULL")
    growing.start(first.where(F.col("ts") < cut), path, min_rows=1)
    growing.extend(first.where(F.col("ts") >= cut), path, min_rows=1)
    monkeypatch.setattr(growing, "SLICE_ROWS", 15, raising=False)
    columns = panels.technical_panel(first, min_rows=1).columns
    before, calls, write = rounded(growing.read(spark, path), columns), [], growing._write_panel

    def broken(rows, *a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(rows, *a)

    with monkeypatch.context() as m:
        m.setattr(growing, "_write_panel", broken)
        with pytest.raises(RuntimeError, match="lost"):
            growing.extend(fixed.where(F.col("ts") >= cut), path, min_rows=1)
    assert folders(tmp_path) == ["panel", "state"] and rounded(growing.read(spark, path), columns) == before
    growing.extend(fixed.where(F.col("ts") >= cut), path, min_rows=1)
    whole = panels.technical_panel(first.where(F.col("ts") < cut).unionByName(fixed.where(F.col("ts") >= cut)), min_rows=1)
    assert rounded(growing.read(spark, path), columns) == rounded(whole, columns) != before


def test_a_start_without_bars_writes_no_snapshot(spark, tmp_path):
    growing.start(bars_of(spark, [2]).where("close < 0"), str(tmp_path))
    assert growing.state(spark, str(tmp_path), dt.date(2030, 1, 1)) is None
