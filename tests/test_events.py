import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.operators import sessions
from barloom.operators.series import plain
from barloom.plans import research

S = plain()


def greedy(at, gap):
    out, last = [], None
    for p in sorted(at):
        if last is None or p - last >= gap:
            out.append(p)
            last = p
    return out


@pytest.mark.parametrize(("gap", "block"), [(1, 4), (7, 5), (7, 50), (40, 16)])
def test_de_overlap_in_blocks_equals_loop(spark, gap, block):
    rng = np.random.default_rng(gap + block)
    rows = [(s, h, int(p)) for s in "AB" for h in (0, 1) for p in rng.choice(400, 400 if h == 0 else 60, replace=False)]
    got = E.de_overlap(spark.createDataFrame(rows, "symbol string, hit int, pos int"), ["symbol", "hit"], gap, block=block)
    assert got.columns == ["symbol", "hit", "pos"]
    found = got.toPandas()
    for s in "AB":
        for h in (0, 1):
            want = greedy([p for a, b, p in rows if (a, b) == (s, h)], gap)
            assert sorted(found[(found.symbol == s) & (found.hit == h)]["pos"]) == want
    assert E.de_overlap(got.where("false"), ["symbol"], gap).count() == 0


def test_an_unbroken_run_of_a_million_rows_is_shared(spark):
    rows = spark.range(1_000_000).select(F.lit("A").alias("symbol"), F.col("id").alias("pos"))
    got = E.de_overlap(rows, ["symbol"], 7)
    assert got.agg(F.count("*"), F.sum((F.col("pos") % 7 != 0).cast("int"))).first() == (142_858, 0)


def test_de_overlap_equals_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(p)) for k in "ab" for p in np.flatnonzero(rng.random(400) < (0.9 if k == "a" else 0.1))]
    got = E.de_overlap(spark.createDataFrame(rows, "symbol string, pos int"), ["symbol"], 7).toPandas()
    for k in "ab":
        want, last = [], -(10**9)
        for p in [p for s, p in rows if s == k]:
            if p - last >= 7:
                want.append(p)
                last = p
        assert sorted(got[got.symbol == k]["pos"]) == want


def walk_out(h, l, c, i, dirn, risk, rr, n):
    stop, tgt = c[i] - dirn * risk, c[i] + dirn * risk * rr
    for j in range(i + 1, min(i + 1 + n, len(c))):
        if (l[j] <= stop) if dirn > 0 else (h[j] >= stop):
            return -1.0
        if (h[j] >= tgt) if dirn > 0 else (l[j] <= tgt):
            return rr
    return dirn * (c[min(i + n, len(c) - 1)] - c[i]) / risk


def test_first_touch_equals_loop(bars, walk):
    g = walk[walk.symbol == "B"].reset_index(drop=True)
    b = E.numbered(E.path_ahead(bars.where("symbol = 'B'"), S, 12), S)
    b = b.withColumn("dirn", F.explode(F.array(F.lit(1), F.lit(-1))))
    r, _ = E.first_touch(F.col("dirn"), F.col("close"), F.lit(1.5), F.lit(2.0))
    got = b.withColumn("r", r).toPandas()
    h, l, c = (g[x].to_numpy() for x in ("high", "low", "close"))
    for row in got.itertuples():
        if row.pos == len(c) - 1:
            assert np.isnan(row.r)
        else:
            assert np.isclose(row.r, walk_out(h, l, c, row.pos, row.dirn, 1.5, 2.0, 12))


def test_stop_wins_a_bar_with_both(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=2), "open": 10.0, "high": [10.0, 20.0], "low": [10.0, 1.0], "close": 10.0})
    b = E.path_ahead(spark.createDataFrame(pdf), S, 5)
    r, n = E.first_touch(F.lit(1), F.col("close"), F.lit(1.0), F.lit(2.0))
    assert [tuple(x) for x in b.orderBy("ts").select(r, n).collect()] == [(-1.0, 1), (None, None)]


def test_placebo_is_reproducible_and_centred(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": "x", "id": np.arange(2000).astype(str), "v": rng.normal(1.0, 1.0, 2000)})
    n = spark.createDataFrame([("x", 50)], "g string, n long")
    a = E.placebo(spark.createDataFrame(pdf), ["g"], n, 100, 7, "v", "id").toPandas()
    b = E.placebo(spark.createDataFrame(pdf.sample(frac=1)).repartition(5), ["g"], n, 100, 7, "v", "id").toPandas()
    assert (a["drawn"] == 50).all() and len(a) == 100
    m = a.merge(b, on="rep")
    assert np.allclose(m["mean_x"], m["mean_y"])
    assert abs(a["mean"].mean() - pdf["v"].mean()) < 0.05
    assert abs(a["mean"].std() - 1 / np.sqrt(50)) < 0.04


def test_walk_forward_stop_never_uses_its_own_year(spark):
    ts = pd.date_range("2018-01-01", "2021-12-31", freq="D")
    pdf = pd.DataFrame({"symbol": "A", "ts": ts, "open": 10.0, "high": 11.0, "low": 9.7, "close": 10.4, "atr": 1.0})
    a = research.walk_forward_stop(research.stop_trades(spark.createDataFrame(pdf), 0.2)).toPandas()
    pdf.loc[pdf.ts >= "2021", "close"] = 5.0
    b = research.walk_forward_stop(research.stop_trades(spark.createDataFrame(pdf), 0.2)).toPandas()
    assert a.sort_values("year")["stop_k"].tolist() == b.sort_values("year")["stop_k"].tolist()
    assert sorted(a["year"]) == [2020, 2021]


def spaced(pos, gap):
    out, last = [], -(10**9)
    for p in pos:
        if p - last >= gap:
            out.append(p)
            last = p
    return out


def test_directional_edge_equals_loop(bars):
    from barloom.operators import rolling

    b = E.numbered(rolling.add_forward_returns(rolling.add_structure(bars, S), S, (5,)), S)
    got = E.directional_edge(b, {5: "fwd5"}).toPandas().set_index(["symbol", "setup"])
    pdf = b.where("symbol = 'HOT'").toPandas().sort_values("pos")
    pdf = pdf[pdf["fwd5"].notna()]
    checked = 0
    for name, (flag, dirn) in E.SETUPS.items():
        ev = spaced(pdf[pdf[flag] == 1]["pos"], 5)
        nv = spaced(pdf[pdf[flag] == 0]["pos"], 5)
        if len(ev) < 12:
            continue
        f = pdf.set_index("pos")["fwd5"] * dirn
        x, y = f.loc[ev], f.loc[nv]
        t = (x.mean() - y.mean()) / np.sqrt(x.var() / len(x) + y.var() / len(y))
        assert got.loc[("HOT", name), "n"] == len(ev) and np.isclose(got.loc[("HOT", name), "t"], t)
        checked += 1
    assert checked >= 5


def test_feature_scan_equals_loop(spark):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame(
        {"symbol": "A", "ts": pd.date_range("2020", periods=n), "m_x": rng.normal(size=n), "s_f": (rng.random(n) < 0.3) * 1.0, "fwd5": rng.normal(size=n)}
    )
    pdf.loc[n - 5 :, "fwd5"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("fwd5", F.when(~F.isnan("fwd5"), F.col("fwd5")))
    got = research.feature_scan(df, S, ["m_x"], ["s_f"], (5,), min_rank=50).toPandas().set_index("feature")
    v = pdf["m_x"].to_numpy()
    rank = np.array([np.nan if i < 50 else (v[:i] < v[i]).mean() for i in range(n)])
    s = pdf.assign(rank=rank)[pdf["fwd5"].notna()].iloc[::5]
    assert np.isclose(got.loc["m_x", "rho"], s["m_x"].rank().corr(s["fwd5"].rank()))
    assert np.isclose(got.loc["m_x", "effect"], s[s["rank"] >= 0.7]["fwd5"].mean() - s[s["rank"] <= 0.3]["fwd5"].mean())
    a, b = s[s["s_f"] == 1]["fwd5"], s[s["s_f"] == 0]["fwd5"]
    assert got.loc["s_f", "n"] == len(a) and np.isclose(got.loc["s_f", "effect"], a.mean() - b.mean())
    assert got.loc["m_x", "group"] == "momentum"
    assert got["t"].abs().sort_values(ascending=False).index.tolist() == got.sort_values("rank").index.tolist()


def test_feature_panel_with_drivers_and_volatility_rank(spark, walk):
    hot = walk[walk.symbol == "HOT"].head(320)
    drivers = pd.concat([hot[["ts", "close"]].assign(symbol=n, close=hot["close"] * (i + 1)) for i, n in enumerate(("dxy", "vix", "slv"))])
    p = research.feature_panel(spark.createDataFrame(hot), S, spark.createDataFrame(drivers), min_rank=100).toPandas().sort_values("ts").reset_index(drop=True)
    v = p["v_atr_pct"].to_numpy(float)
    want = [np.nan if i < 100 else (v[:i] < v[i]).mean() for i in range(len(v))]
    assert len(p) == 320 and np.allclose(p["v_atr_rank"].astype(float), want, equal_nan=True)
    assert np.allclose(p["c_vix_lvl"].astype(float), 2 * hot["close"].to_numpy()) and np.allclose(p["c_gold_silver"].astype(float), 1 / 3)
    assert p["c_oil_roc5"].isna().all()


def test_zones_against_random_entries(spark):
    rng = np.random.default_rng(8)
    rows = [("A", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), i % 24, d, float(rng.normal(0.9 * (i % 24 == 7) * d, 1))) for i in range(24 * 40) for d in (1, -1)]
    rows += [("B", pd.Timestamp("2024-01-01"), 7, 1, 1.0)]  # too few
    pool = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "hour", "dirn", "r"]))
    zones = [("seven", 7), ("ten", 10), ("also seven", 7)]
    got = {(r.symbol, r.zone, r.dirn): r for r in sessions.zone_control(pool, zones, 200, 1, 30).collect()}
    assert set(got) == {("A", z, d) for z, _ in zones for d in (1, -1)} and {r.n for r in got.values()} == {40}
    for (_, zone, d), r in got.items():
        mine = [x[4] for x in rows if x[0] == "A" and x[2] == dict(zones)[zone] and x[3] == d]
        rest = [x[4] for x in rows if x[0] == "A" and x[3] == d]
        assert abs(r["mean"] - np.mean(mine)) < 1e-12
        assert abs(r.random_mean - np.mean(rest)) < 4 * np.std(rest) / np.sqrt(40 * 200)
        draws = [np.mean(rng.choice(rest, 40, replace=False)) for _ in range(2000)]
        assert abs(r.percentile - 100 * np.mean(np.array(draws) < np.mean(mine))) < 15
    assert got["A", "seven", 1].verdict == "beats random" and got["A", "seven", -1].verdict == "worse"


def test_both_ways_by_a_plain_loop(spark, bars, walk):
    df = bars.withColumn("atr", F.when(F.col("volume") > 10, F.col("volume") / 20))
    got = {(r.symbol, str(r.ts), r.dirn): (r.r, r.bars) for r in E.both_ways(df, S, 5, 1.5, 2.0, 0.05, 8).collect()}
    want = {}
    for sym, g in walk.groupby("symbol"):
        g = g.reset_index(drop=True)
        for i in range(len(g) - 8):
            atr = g.volume[i] / 20
            if g.volume[i] <= 10:
                continue
            for d in (1, -1):
                risk, end = 1.5 * atr, None
                for j in range(i + 1, i + 6):
                    low, high = g.low[j], g.high[j]
                    stopped = low <= g.close[i] - risk if d > 0 else high >= g.close[i] + risk
                    hit = high >= g.close[i] + 2 * risk if d > 0 else low <= g.close[i] - 2 * risk
                    if stopped or hit:
                        end = (-1.0 if stopped else 2.0, j - i)
                        break
                end = end or (d * (g.close[i + 5] - g.close[i]) / risk, 5)
                want[sym, str(g.ts[i]), d] = (end[0] - 0.1 / 1.5, end[1])
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
