import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ranks, rolling
from barloom.operators.ema import add_ema, reach, segment_rows, span_alpha, wilder_alpha
from barloom.operators.series import keep_own, plain, split, time_bucket, with_position
from barloom.plans import panels

S = plain()


def by_symbol(df):
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    return {k: g.reset_index(drop=True) for k, g in pdf.groupby("symbol")}


def test_ema_equals_pandas(bars, walk):
    specs = {"e9": ("close", span_alpha(9)), "e200": ("close", span_alpha(200)), "w24": ("close", wilder_alpha(24))}
    got = by_symbol(add_ema(bars, S, specs))
    for sym, g in walk.groupby("symbol"):
        for out, (_, a) in specs.items():
            want = g["close"].ewm(alpha=a, adjust=False).mean().to_numpy()
            assert np.allclose(got[sym][out], want, rtol=1e-11, atol=0)


def test_ema_across_long_segments(spark):
    n = 25_000
    x = np.random.default_rng(0).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2000", periods=n, freq="min"), "x": x}))
    got = by_symbol(add_ema(df, S, {"f": ("x", span_alpha(5)), "s": ("x", span_alpha(400))}))["A"]
    for out, span in (("f", 5), ("s", 400)):
        assert np.allclose(got[out], pd.Series(x).ewm(span=span, adjust=False).mean(), atol=1e-12)


def test_ema_starts_at_first_value(spark):
    x = [None, None, 4.0, 6.0, 5.0]
    df = spark.createDataFrame(
        pd.DataFrame({"symbol": "A", "ts": pd.date_range("2000", periods=5), "x": x})
    ).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = by_symbol(add_ema(df, S, {"y": ("x", 0.25)}, late=("x",)))["A"]["y"]
    want = pd.Series(x, dtype=float).ewm(alpha=0.25, adjust=False).mean()
    assert np.allclose(got, want, equal_nan=True)


def test_segment_length_is_safe():
    for a in (span_alpha(4), span_alpha(9), wilder_alpha(14), span_alpha(200)):
        n = segment_rows(a)
        assert (1 - a) ** n <= 1e-20 and (1 - a) ** -n < 1e300
        assert reach(a) <= n


def test_position_of_hot_key(bars, walk):
    df = with_position(bars.repartition(7), ("symbol",), ["ts"], time_bucket("ts", 86_400), "p")
    for g in by_symbol(df).values():
        assert g["p"].tolist() == list(range(len(g)))


def test_blocked_layout_equals_plain(bars):
    a = add_ema(rolling.add_rsi(rolling.add_moves(bars, S), S), S, {"e": ("close", span_alpha(21))})
    blocks, bs = split(bars, S, back=reach(span_alpha(21)) + 20, block_rows=600, bucket_seconds=86_400)
    assert blocks.where("symbol = 'HOT' AND _own").select("_blk").distinct().count() == 5
    b = rolling.add_rsi(rolling.add_moves(blocks, bs), bs)
    b = keep_own(add_ema(b, bs, {"e": ("close", span_alpha(21))}))
    x, y = by_symbol(a), by_symbol(b)
    for sym in x:
        assert len(x[sym]) == len(y[sym])
        for c in ("rsi", "ret", "e"):
            assert np.allclose(x[sym][c].astype(float), y[sym][c].astype(float), rtol=1e-12, equal_nan=True)


def test_lead_in_blocks(bars):
    blocks, bs = split(bars, S, back=0, ahead=20, block_rows=100, bucket_seconds=86_400)
    y = by_symbol(keep_own(rolling.add_forward_returns(blocks, bs, (20,))))
    x = by_symbol(rolling.add_forward_returns(bars, S, (20,)))
    for sym in x:
        assert np.allclose(x[sym]["fwd20"].astype(float), y[sym]["fwd20"].astype(float), equal_nan=True)


def test_rolling_against_pandas(bars, walk):
    b = rolling.add_atr(rolling.add_bollinger(rolling.add_rsi(rolling.add_moves(bars, S), S), S), S)
    got = by_symbol(b)
    for sym, g in walk.groupby("symbol"):
        g = g.reset_index(drop=True)
        d = g["close"].diff()
        up, dn = d.clip(lower=0).rolling(14).mean(), (-d.clip(upper=0)).rolling(14).mean()
        assert np.allclose(got[sym]["rsi"].astype(float), 100 - 100 / (1 + up / dn), equal_nan=True)
        sd = g["close"].rolling(20).std()
        assert np.allclose(got[sym]["bb_upper"].astype(float), g["close"].rolling(20).mean() + 2 * sd, equal_nan=True)
        pc = g["close"].shift()
        tr = pd.concat([g.high - g.low, (g.high - pc).abs(), (g.low - pc).abs()], axis=1).max(axis=1)
        assert np.allclose(got[sym]["atr"].astype(float), tr.rolling(14).mean(), equal_nan=True)


def test_rsi_without_losses_is_unknown(spark):
    df = spark.createDataFrame(
        pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=40), "close": np.arange(40.0) + 1})
    ).withColumns({"high": F.col("close"), "low": F.col("close"), "open": F.col("close"), "volume": F.lit(1.0)})
    p = panels.technical_panel(df)
    row = p.orderBy(F.col("ts").desc()).first()
    assert row["rsi"] == 50.0 and row["s_rsi"] == 55.0


def test_panel_is_causal_and_bounded(spark, walk):
    hot = walk[walk.symbol == "HOT"]
    full = panels.technical_panel(spark.createDataFrame(hot.head(400))).toPandas().set_index("ts")
    cut = panels.technical_panel(spark.createDataFrame(hot.head(300))).toPandas().set_index("ts")
    both = full.loc[cut.index]
    assert np.allclose(both["tech_score"], cut["tech_score"])
    assert full["tech_score"].between(0, 100).all() and len(cut) == 300 - 29


def test_expanding_rank_brute_force(bars, walk):
    got = by_symbol(ranks.expanding_rank(bars, S, "close", "p", min_obs=30, block_rows=64, bucket_seconds=86_400))
    for sym, g in walk.groupby("symbol"):
        v = g["close"].to_numpy()
        want = [np.nan if i < 30 else (v[:i] < v[i]).mean() for i in range(len(v))]
        assert np.allclose(got[sym]["p"].astype(float), want, equal_nan=True)


def test_expanding_rank_with_ties(spark):
    v = np.random.default_rng(1).integers(0, 5, 300).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=300), "x": v}))
    got = by_symbol(ranks.expanding_rank(df, S, "x", "p", min_obs=10, block_rows=16))["A"]["p"].astype(float)
    assert np.allclose(got, [np.nan if i < 10 else (v[:i] < v[i]).mean() for i in range(300)], equal_nan=True)


def test_counting_by_merging_equals_a_loop():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 7, 64, 65, 300):
        v = rng.integers(0, 20, n).astype(float)
        assert ranks._earlier_and_lower(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]


@pytest.mark.parametrize(("kind", "n"), [("narrow", 200_000), ("heavy", 1_000_000)])
def test_expanding_rank_of_a_million_rows_of_one_key(spark, kind, n):
    rng = np.random.default_rng(7)
    v = 1.0 + rng.random(n) * 1e-9 if kind == "narrow" else np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 50, n))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=n, freq="min"), "x": v}))
    got = ranks.expanding_rank(df, S, "x", "p", min_obs=1).select("ts", "p").toPandas().sort_values("ts")["p"].to_numpy()
    for i in rng.integers(1, n, 40).tolist() + [n - 1]:
        assert np.isclose(got[i], (v[:i] < v[i]).mean())


def test_rolling_rank_brute_force(bars, walk):
    got = by_symbol(ranks.rolling_rank(bars, S, "close", "p", n=50, min_obs=20, block_rows=200))
    for sym, g in walk.groupby("symbol"):
        want = g["close"].rolling(50, min_periods=20).rank(pct=True)
        assert np.allclose(got[sym]["p"].astype(float), want, equal_nan=True)


def test_losing_run_and_drawdown(spark):
    net = [-1.0, -2.0, 3.0, -1.0, -1.0, -1.0, 2.0]
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020", periods=7), "net": net}))
    df = rolling.add_equity(df, S, "net").withColumn("win", F.col("net") > 0)
    got = by_symbol(rolling.add_losing_run(df, S, "win"))["A"]
    assert got["drawdown"].min() == -3.0  # measured from the opening balance of zero
    assert got["losing_run"].max() == 3


def test_average_refuses_a_gap_inside_a_series(spark):
    from barloom.operators.ema import add_ema

    rows = [("A", i, None if i in gaps else float(i)) for gaps in [{0, 1}] for i in range(6)] + [("B", i, None if i == 3 else 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "symbol string, ts int, x double").withColumn("ts", F.timestamp_seconds("ts"))
    ok = add_ema(df.where("symbol = 'A'"), S, {"y": ("x", 0.2)}, late=("x",)).orderBy("ts").collect()
    assert [r.y for r in ok][:4] == [None, None, 2.0, pytest.approx(2.2)]
    with pytest.raises(Exception, match="NULL inside"):
        add_ema(df, S, {"y": ("x", 0.2)}, late=("x",)).collect()
