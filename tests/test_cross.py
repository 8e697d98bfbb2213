import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.num import banded, clamp, non_null_mean
from barloom.functions.stats import t_two_sided
from barloom.operators import cross, evaluate
from barloom.operators.series import plain


def frame(seed=0, dates=4, n=60):
    rng = np.random.default_rng(seed)
    rows = [
        (f"d{d}", f"S{i}", float(rng.integers(0, 12)), float(rng.normal()))
        for d in range(dates)
        for i in range(n if d else 3 * n)
    ]
    return pd.DataFrame(rows, columns=["date", "symbol", "score", "fwd"])


@pytest.mark.parametrize("large", [None, True, False])
def test_average_rank_with_many_ties(spark, large):
    pdf = frame()
    got = cross.average_rank(spark.createDataFrame(pdf), ["date"], "score", "r", large=large).toPandas()
    want = pdf.assign(r=pdf.groupby("date")["score"].rank())
    m = got.merge(want, on=["date", "symbol"])
    assert len(m) == len(pdf) and np.allclose(m["r_x"], m["r_y"])


@pytest.mark.parametrize("large", [None, True, False])
def test_ordinal_rank_both_ways(spark, large):
    pdf = frame(1)
    for desc in (False, True):
        got = cross.ordinal_rank(spark.createDataFrame(pdf), ["date"], "score", "symbol", descending=desc, large=large).toPandas()
        want = pdf.sort_values(["score", "symbol"], ascending=[not desc, True])
        want = want.assign(w=want.groupby("date").cumcount() + 1)
        m = got.merge(want, on=["date", "symbol"])
        assert (m["r"] == m["w"]).all()


def test_quintiles_equal_qcut(spark):
    for n in (5, 7, 11, 23, 40, 101):
        pdf = pd.DataFrame({"date": "d", "symbol": [f"{i:03d}" for i in range(n)], "score": np.random.default_rng(n).normal(size=n)})
        got = cross.quintiles(spark.createDataFrame(pdf), "date", "score").toPandas().sort_values("symbol")
        want = pd.qcut(pdf["score"].rank(method="first"), 5, labels=False)
        assert got["q"].tolist() == want.tolist()


def test_rank_ic_equals_pandas(spark):
    pdf = frame(2)
    got = cross.rank_ic(spark.createDataFrame(pdf), ["date"], "score", "fwd").toPandas().set_index("date")["ic"]
    for d, g in pdf.groupby("date"):
        want = g["score"].rank().corr(g["fwd"].rank())
        assert abs(got[d] - want) < 1e-12


def test_decile_edges_equal_nlargest(spark):
    pdf = frame(3, n=25)
    got = cross.decile_edges(spark.createDataFrame(pdf), ["date"], "score", "fwd").toPandas().set_index("date")
    for d, g in pdf.groupby("date"):
        k = max(1, int(round(len(g) * 0.1)))
        top = g.sort_values(["score", "symbol"], ascending=[False, True]).head(k)["fwd"].mean()
        assert abs(got.loc[d, "edge"] - (top - g["fwd"].mean())) < 1e-12


def greedy(rows, n, cap=3):
    used, picked, rest = {}, [], []
    for r in rows:
        if len(picked) == n:
            break
        if used.get(r[1], 0) < cap:
            picked.append(r)
            used[r[1]] = used.get(r[1], 0) + 1
        else:
            rest.append(r)
    return [r[0] for r in (picked + rest)[:n]]


def test_sector_cap_equals_greedy(spark):
    rnd = random.Random(5)
    for trial in range(6):
        size = rnd.choice([6, 15, 60])
        rows = [(f"S{i:02d}", rnd.choice("abc" if trial % 2 else "abcdefg"), rnd.randint(0, 30)) for i in range(size)]
        df = spark.createDataFrame(rows, "symbol string, sector string, total int")
        got = [r["symbol"] for r in cross.sector_capped_top(df, 10).orderBy("rank").collect()]
        assert got == greedy(sorted(rows, key=lambda r: (-r[2], r[0])), 10)


def test_gated_names_come_last_but_stay(spark):
    rows = [("A", "x", 90, False), ("B", "x", 10, True), ("C", "y", 50, True)]
    df = spark.createDataFrame(rows, "symbol string, sector string, bear_score int, tradeable boolean")
    got = cross.sector_capped_top(df, 3, "bear_score", tradeable="tradeable").orderBy("rank").collect()
    assert [r["symbol"] for r in got] == ["C", "B", "A"]


def test_zscore_flat_group_and_clip(spark):
    pdf = pd.DataFrame({"ts": ["a"] * 3 + ["b"] * 40, "x": [5.0] * 3 + [0.0] * 39 + [1000.0]})
    df = spark.createDataFrame(pdf)
    z = cross.zscores(df, ["x"]).toPandas()
    assert z[z.ts == "a"]["x_z"].isna().all() and z["x_z"].max() == 3.0
    assert (cross.zscores(df, ["x"], flat=0.0).where("ts = 'a'").toPandas()["x_z"] == 0).all()


def test_clamp_and_row_mean_keep_null(spark):
    df = spark.createDataFrame([(None, 4.0), (9.0, None)], "a double, b double")
    rows = df.select(clamp("a", -3, 3).alias("c"), non_null_mean(F.col("a"), F.col("b")).alias("m")).collect()
    assert rows[0]["c"] is None and rows[1]["c"] == 3.0
    assert [r["m"] for r in rows] == [4.0, 9.0]


def test_band_boundaries(spark):
    from barloom.functions import tables as t

    tables = {k: v for k, v in vars(t).items() if isinstance(v, tuple) and len(v) == 3 and v[0] in ("<", "<=", ">", ">=")}
    assert len(tables) > 15
    for op, steps, other in tables.values():
        xs = sorted({b + e for b, _ in steps for e in (-1e-9, 0.0, 1e-9)})
        df = spark.createDataFrame([(float(x),) for x in xs], "x double")
        got = {r["x"]: r["s"] for r in df.select("x", banded("x", op, steps, other).alias("s")).collect()}
        for x in xs:
            hits = [s for b, s in steps if eval(f"x {op} b")]
            assert got[x] == (hits[0] if hits else other)


def test_point_in_time_uses_gap_rules(spark):
    """A symbol without a bar on the date: its last bar before counts, forward bars from the next one."""
    days = pd.date_range("2020-01-01", periods=12)
    full = pd.DataFrame({"symbol": "A", "ts": days, "close": np.arange(12) + 1.0})
    gap = full.assign(symbol="B").drop(index=5)
    panel = spark.createDataFrame(pd.concat([full, gap])).withColumn("row_no", F.lit(99))
    cal = cross.calendar(panel.where("symbol = 'A'"))
    dates = cal.where("day_no = 5")
    s = plain()
    got = evaluate.point_in_time(panel, s, dates, cal, 5, (2,), 5).toPandas().set_index("symbol")
    assert got.loc["A", "close"] == 6 and np.isclose(got.loc["A", "fwd2"], 8 / 6 - 1)
    assert got.loc["B", "close"] == 5 and np.isclose(got.loc["B", "fwd2"], 9 / 5 - 1)


def test_t_table():
    for t, df, p in ((12.706, 1, 0.05), (2.228, 10, 0.05), (2.750, 30, 0.01), (1.984, 100, 0.05), (3.291, 1e6, 0.001)):
        assert abs(t_two_sided(t, df) - p) < 2e-4 * max(1, p * 100)
    assert t_two_sided(0.0, 5) == 1.0


@pytest.mark.parametrize("scale", [1e-3, 1e7])
def test_ranks_of_narrow_and_wide_values(spark, scale):
    pdf = frame(5)
    pdf["fwd"] = pdf["fwd"] * scale
    got = cross.average_rank(spark.createDataFrame(pdf), ["date"], "fwd", "r", large=True).toPandas()
    want = got.groupby("date")["fwd"].rank()
    assert (got["r"] == want).all() and len(got) == len(pdf)
