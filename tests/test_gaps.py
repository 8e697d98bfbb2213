"""Gaps, short histories and sparse symbols: no row and no name may be lost."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.num import printed
from barloom.operators import events, sessions, universe
from barloom.plans import panels, research, screens
from barloom.sources import feeds
from barloom.streaming import latch, ticks

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 5, 9)


@pytest.fixture(scope="module")
def hourly(spark):
    """A symbol that trades before and after a weekend, and one with a single bar."""
    rows = []
    for i in range(300):
        ts = START - (300 - i) * HOUR if i < 290 else START + dt.timedelta(days=3) + (i - 290) * HOUR
        rows.append(("GAP", ts, 100.0 + i, 99.0 + i, 2.0))
    rows.append(("THIN", START, 10.0, 9.0, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, ema50 double, ema200 double, atr double")


def test_live_bias_keeps_every_tick(spark, hourly):
    at = [("GAP", START - 400 * HOUR), ("GAP", START - 200 * HOUR), ("GAP", START + HOUR * 30), ("GAP", START + dt.timedelta(days=3, hours=2, minutes=5)), ("THIN", START + 5 * HOUR), ("NONE", START)]
    quoted = spark.createDataFrame([(s, t, 1000.0) for s, t in at], "symbol string, ts timestamp, price double")
    got = {(r.symbol, r.ts): r for r in ticks.live_bias(quoted, hourly).collect()}
    assert set(got) == set(at)
    bars = sorted((r.ts, r.ema50) for r in hourly.where("symbol = 'GAP'").collect())
    for s, t in at:
        row = got[s, t]
        seen = [b for b in bars if s == "GAP" and b[0] + HOUR <= t.replace(minute=0)]
        want = "no bars" if s == "NONE" or (s == "GAP" and not seen) else "short history" if s == "THIN" or len(seen) < 210 else "ok"
        assert row.status == want and (row.bias == "BULLISH") == (want == "ok") and (row.risk is None) == (want != "ok")
        if seen:
            assert row.ema50 == seen[-1][1]


def test_rows_without_a_bias_touch_levels_but_issue_nothing():
    live = latch.Live()
    row = {"sec": 0.0, "price": 100.0, "dirn": 1, "bias": "BULLISH", "risk": 2.0, "market_open": True}
    assert [e for e, _ in latch.step(live, row, 5)] == ["ISSUED"]
    silent = row | {"bias": None, "dirn": float("nan"), "risk": float("nan")}
    assert latch.step(live, silent | {"sec": 1.0, "price": 99.0}, 5) == []
    assert [e for e, _ in latch.step(live, silent | {"sec": 2.0, "price": 98.0}, 5)] == ["STOPPED"]
    assert latch.step(live, silent | {"sec": 3000.0}, 5) == []


def test_a_near_miss_is_no_touch():
    """0.1 + 0.2 style rounding of a difference must not reach a level that the price has not."""
    live = latch.Live(signal={"dirn": 1, "entry": 1.1, "stop": 0.7, "tp1": 1.9, "tp2": 2.3, "status": "ACTIVE", "mfe": 0.0, "mae": 0.0})
    assert latch._touched(live.signal, 0.7000000000000001) is None and latch._touched(live.signal, 0.7) == "STOPPED"


def test_panels_skip_incomplete_bars(spark):
    rng = random.Random(1)
    rows = [("A", START + i * HOUR, *(100 + rng.random() for _ in range(4)), 5.0) for i in range(120)]
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    holes = [r if i % 7 else (*r[:5], None, r[6]) for i, r in enumerate(rows)]
    whole = [r for i, r in enumerate(rows) if i % 7]
    pick = ["ts", "ema9", "ema21", "rsi", "atr", "adx", "macd_hist", "row_no"]
    a, b = (sorted(map(tuple, panels.indicator_panel(spark.createDataFrame(x, schema)).select(*pick).collect())) for x in (holes, whole))
    assert a == b
    close = pd.Series([r[5] for r in whole]).ewm(span=9, adjust=False).mean()
    assert abs(a[-1][1] - close.iloc[-1]) < 1e-9


def test_screens_keep_names_with_few_bars(spark):
    rng = random.Random(2)
    rows = []
    for sym, n in (("LONG", 80), ("MID", 45), ("NEW", 3), ("ONE", 1), ("BENCH", 80)):
        rows += [(sym, START + i * dt.timedelta(days=7), *(50 + rng.random() * 9 for _ in range(4)), 1e6) for i in range(80 - n, 80)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    facts = spark.createDataFrame(
        [(s, s, "Energy", 1e9, 1.0, 3, 1.0, 0.01) for s in ("LONG", "MID", "NEW", "ONE", "BENCH")],
        "symbol string, company_name string, raw_sector string, shares double, beta double, analyst_count int, target_mult double, dividend_yield double",
    )
    statements = spark.createDataFrame([], "symbol string, statement string, item string, fiscal_date date, value double")
    news = spark.createDataFrame([], "symbol string, news_count long, news_score double, headline string")
    got = {r.symbol: r for r in screens.long_scores(bars, statements, facts, news, {"Energy": "LONG"}).collect()}
    assert set(got) == {"LONG", "MID", "NEW", "ONE", "BENCH"} and got["NEW"].tech_score == 50.0
    assert "Insufficient data" in got["NEW"].signals and "Insufficient data" not in got["MID"].signals
    short = {r.symbol: r for r in screens.short_scores(bars, facts, "BENCH").collect()}
    assert set(short) == set(got) and short["MID"].bear_score == 50.0 and not short["MID"].tradeable
    assert short["MID"].gate_reasons == ["insufficient history"] and short["LONG"].gate_reasons != ["insufficient history"]
    year = {r.symbol: r for r in panels.year_range(bars).collect()}
    last = sorted(r[1] for r in rows)[-1]
    assert year["LONG"].hi52 == max(r[3] for r in rows if r[0] == "LONG" and r[1] > last - dt.timedelta(days=364))


def test_the_first_pull_stays(spark):
    schema = "symbol string, ts timestamp, close double"
    a = spark.createDataFrame([("A", START, 1.0)], schema)
    b = spark.createDataFrame([("A", START, 2.0), ("A", START + HOUR, 3.0)], schema)
    assert sorted((r.ts, r.close) for r in feeds.merge_pulls(a, b).collect()) == [(START, 1.0), (START + HOUR, 3.0)]
    assert sorted(r.close for r in feeds.merge_pulls(b, a).collect()) == [2.0, 3.0]


def test_spread_percentiles_count_values(spark):
    rng = random.Random(3)
    values = [rng.choice([0.1, 0.2, 0.2, 0.5, 0.9]) for _ in range(501)] + [-1.0, 0.0]
    df = spark.createDataFrame([("A", v) for v in values], "symbol string, sp double")
    (r,) = universe.spread_distribution(df, "sp", 5.0).collect()
    s = pd.Series([v for v in values if v > 0])
    assert r.n == 501 and abs(r.p90_spread - s.quantile(0.9)) < 1e-12 and abs(r.mean_spread - s.mean()) < 1e-12


def test_numbers_print_like_python(spark):
    rng = random.Random(4)
    xs = [3.55, 58.15, 0.25, 0.35, -2.45, -0.05, 2.5, 1e6 + 0.05] + [round(rng.uniform(-500, 500), 2) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, shown in df.select("x", F.format_string("%.1f", printed("x"))).collect():
        assert float(shown) == float(f"{x:.1f}"), x


def test_survivors_and_periods(spark):
    results = spark.createDataFrame([("a", 9.0, 50), ("b", 2.1, 50), ("c", None, 3)], "name string, t double, n long")
    assert [r.name for r in events.survivors(results, "t", "n").collect()] == ["a"]
    trades = spark.createDataFrame([(dt.datetime(2023, 12, 30),), (dt.datetime(2024, 1, 2),), (dt.datetime(2024, 1, 20),)], "ts timestamp")
    got = sorted((str(r.ts)[:10], r.period) for r in sessions.by_period(trades, "INTERVAL 14 DAYS").collect())
    assert len(got) == 9 and ("2024-01-20", "holdout") in got and ("2024-01-02", "train") in got and ("2023-12-30", "2023") in got


def test_cards_wait_for_their_history(spark, bars):
    b = sessions.add_clock(bars.where("symbol in ('HOT', 'B')"))
    from barloom.operators.series import plain

    got = research.bias_card(b, plain()).groupBy("symbol", "status").agg(F.count("*").alias("n"), F.count("bias").alias("k")).collect()
    assert {(r.symbol, r.status, r.n, r.k) for r in got} == {("HOT", "ok", 2291, 2291), ("HOT", "short history", 209, 0), ("B", "short history", 120, 0)}


def test_batches_of_a_latch_equal_single_rows():
    rng = random.Random(9)
    for run in range(40):
        rows, price, now = [], 100.0, dt.datetime(2024, 1, 1)
        for _ in range(300):
            price = max(-1.0, price + rng.gauss(0, 2))
            now += dt.timedelta(minutes=rng.choice([0, 1, 30]))
            bias = rng.choice(["BULLISH"] * 6 + ["BEARISH"] * 2 + ["MIXED", None])
            rows.append(
                {"key": "K", "ts": now, "bias": bias, "dirn": {"BULLISH": 1, "BEARISH": -1, "MIXED": 1}.get(bias), "price": rng.choice([price] * 9 + [float("nan")]),
                 "risk": rng.choice([3.0] * 5 + [0.0, float("nan")]), "atr": 2.0, "market_open": rng.random() < 0.9, "control": rng.choice([None] * 30 + ["CLOSE"])}
            )
        one, want = latch.Live(), []
        for r in rows:
            full = r | {"sec": latch._micros(r["ts"])}
            want += [latch._event("K", full, e, sig) for e, sig in latch.step(one, full, 45.0)]
        many, got = latch.Live(), []
        pdf = pd.DataFrame(rows)
        for lo in range(0, 300, 70):
            batch = latch.Batch(pdf.iloc[lo : lo + 70].reset_index(drop=True))
            batch.LOOK = 7
            got += latch.advance(many, batch, 0, len(batch.sec), 45.0)
        drop = lambda es: [{k: v for k, v in e.items() if k != "price"} for e in es]
        assert drop(got) == drop(want) and len(want) > 3 and many == one, run


def test_a_million_rows_of_one_key_pass_quickly():
    n = 1_000_000
    price = 100 + np.random.default_rng(1).normal(0, 0.02, n).cumsum()
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s")
    pdf = pd.DataFrame({"key": "K", "ts": ts, "bias": "BULLISH", "dirn": 1, "price": price.clip(1), "risk": 5.0, "atr": 3.0, "market_open": True})
    t0 = time.process_time()
    batch = latch.Batch(pdf)
    assert latch.advance(latch.Live(), batch, 0, n, 45.0) and time.process_time() - t0 < 10
