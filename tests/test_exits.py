"""Exits over long horizons and keyed draws, against plain loops."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import draws
from barloom.operators import events as E
from barloom.operators import exits, series

S = series.plain("symbol")


def walk_out(h, l, c, i, dirn, entry, risk, rr, n):
    """(r, bars) by looking at one bar after another; (None, None) without a bar ahead or a risk."""
    if not risk > 0 or i == len(c) - 1:
        return None, None
    stop, target = entry - dirn * risk, entry + dirn * risk * rr
    last = min(i + n, len(c) - 1)
    for j in range(i + 1, last + 1):
        if (l[j] <= stop) if dirn > 0 else (h[j] >= stop):
            return -1.0, j - i
        if (h[j] >= target) if dirn > 0 else (l[j] <= target):
            return rr, j - i
    return dirn * (c[last] - entry) / risk, last - i


@pytest.fixture(scope="module")
def path():
    rng = np.random.default_rng(9)
    n = 6000
    c = 100 + np.cumsum(rng.normal(0, 0.3, n))
    h, l = c + rng.random(n), c - rng.random(n)
    h[rng.random(n) < 0.01] = np.nan
    return pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=n, freq="h"), "high": h, "low": l, "close": c, "junk": "x"})


@pytest.mark.parametrize("horizon,block", [(2000, 2000), (7, 64), (1, 5), (2000, 65_536)])
def test_exits_of_any_horizon_equal_a_loop(spark, path, horizon, block):
    bars = spark.createDataFrame(path).withColumn("high", F.nanvl("high", F.lit(None).cast("double")))
    grid = [(1, 1.5, 2.0), (-1, 1.5, 2.0), (1, 8.0, 3.0), (-1, 40.0, 1.0), (1, 0.0, 1.0)]
    trades = F.array(*[F.struct(F.lit(d).alias("dirn"), F.col("close").alias("entry"), F.lit(k).alias("risk"), F.lit(x).alias("rr")) for d, k, x in grid])
    rows = exits.first_touch_exits(bars, S, F.when(F.minute("ts") == 0, trades), horizon, block_rows=block).orderBy("ts").collect()
    assert len(rows) == len(path) and rows[0].junk == "x"
    h, l, c = (path[x].to_numpy() for x in ("high", "low", "close"))
    for i in [*range(0, len(path), 97), len(path) - 2, len(path) - 1]:
        for (d, k, x), got in zip(grid, rows[i].exits, strict=True):
            r, held = walk_out(h, l, c, i, d, c[i], k, x, horizon)
            assert got.bars == held and (got.r is None if r is None else np.isclose(got.r, r, rtol=1e-12)), (i, d, k)


def test_exits_of_odd_rows(spark):
    """Null trades, empty ones, null levels, two symbols, a bar with both levels, an empty table."""
    schema = "symbol string, ts timestamp, high double, low double, close double, t array<struct<dirn:int,entry:double,risk:double,rr:double>>"
    at = [datetime.datetime(2020, 1, 1, i) for i in range(3)]
    rows = [
        ("A", at[0], 10.0, 10.0, 10.0, [(1, 10.0, 1.0, 2.0), (1, None, 1.0, 2.0), (-1, 10.0, 1.0, 2.0)]),
        ("A", at[1], 20.0, 1.0, 10.0, None),
        ("A", at[2], None, None, None, []),
        ("B", at[0], 10.0, 10.0, 10.0, [(1, 10.0, 5.0, 2.0)]),
        ("B", at[1], None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.symbol, r.ts): r.exits for r in exits.first_touch_exits(df, S, F.col("t"), 500).collect()}
    assert [tuple(x) for x in got["A", at[0]]] == [(-1.0, 1), (None, None), (-1.0, 1)]
    assert got["A", at[1]] is None and got["A", at[2]] == []
    assert [tuple(x) for x in got["B", at[0]]] == [(None, 1)]
    assert exits.first_touch_exits(df.where("false"), S, F.col("t"), 500).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 16, 17, 4097])
def test_keyed_numbers_are_a_permutation(size):
    for key in (0, -1, 2**62):
        got = draws.permute(np.arange(size), np.full(size, size), np.full(size, key))
        assert sorted(got.tolist()) == list(range(size))


def test_every_order_is_as_likely():
    n, many = 3, 20_000
    got = draws.permute(np.tile(np.arange(n), many), np.full(n * many, n), np.repeat(np.arange(many) * 7919, n)).reshape(many, n)
    _, counts = np.unique(got @ [9, 3, 1], return_counts=True)
    assert len(counts) == 6 and abs(counts - many / 6).max() < 5 * np.sqrt(many / 6)


def test_draws_take_each_row_once_and_all_of_a_short_group(spark, monkeypatch):
    monkeypatch.setattr(draws, "BUCKET_ROWS", 7)
    monkeypatch.setattr(draws, "DRAW_CHUNK", 5)
    value = [float(2**i) for i in range(40)] + [1.0, 2.0, 4.0, None]
    rows = spark.createDataFrame([("a" if i < 40 else "b" if i < 43 else "c", str(i), v) for i, v in enumerate(value)], "g string, id string, v double")
    n = spark.createDataFrame([("a", 12), ("b", 9), ("c", 4), ("d", 4)], "g string, n long")
    got = E.placebo(rows, ["g"], n, 30, 3, "v", "id").toPandas()
    a, b = got[got.g == "a"], got[got.g == "b"]
    assert len(a) == len(b) == 30 and set(got.g) == {"a", "b"}
    assert (a.drawn == 12).all() and all(bin(round(m * 12)).count("1") == 12 for m in a["mean"])  # powers of two: no row twice
    assert a["mean"].nunique() > 25
    assert (b.drawn == 3).all() and np.allclose(b["mean"], 7 / 3)
