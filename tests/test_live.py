import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import sessions
from barloom.streaming import latch, live, ticks

IN = "key string, ts timestamp, bias string, dirn int, price double, risk double, atr double, market_open boolean"


def script(prices, key="G", dirn=1, bias="BULLISH", risk=10.0, start="2024-01-02 10:00", minutes=10, open_=True):
    t0 = pd.Timestamp(start)
    return [
        (key, (t0 + pd.Timedelta(minutes=minutes * i)).to_pydatetime(), bias, dirn, float(p), risk, risk, open_)
        for i, p in enumerate(prices)
    ]


def replay(spark, rows, cooldown=60.0):
    out = latch.latch_batch(spark.createDataFrame(rows, IN), cooldown).orderBy("key", "ts").collect()
    return [(r["key"], r["event"]) for r in out]


def test_stop_cooldown_and_reissue(spark):
    # issued at 100, stopped at 90; blocked for an hour in the same direction, then issued again
    got = replay(spark, script([100, 90, 95, 95, 95, 95, 95, 95]))
    assert [e for _, e in got] == ["ISSUED", "STOPPED", "ISSUED"]


def test_stop_still_works_after_first_target(spark):
    got = replay(spark, script([100, 120, 89]))
    assert [e for _, e in got] == ["ISSUED", "TP1_HIT", "STOPPED"]


def test_second_target_then_reissue_on_same_tick(spark):
    got = replay(spark, script([100, 120, 131]))
    assert [e for _, e in got] == ["ISSUED", "TP1_HIT", "TP2_HIT", "ISSUED"]


def test_flip_and_mixed(spark):
    a = script([100])
    mixed = script([101], dirn=-1, bias="MIXED", start="2024-01-02 10:10")
    flip = script([101], dirn=-1, bias="BEARISH", start="2024-01-02 10:20")
    assert [e for _, e in replay(spark, a + mixed + flip)] == ["ISSUED", "FLIPPED", "ISSUED"]
    assert [e for _, e in replay(spark, script([100], bias="MIXED"))] == ["ISSUED"]


def test_flip_into_a_cooling_direction_is_blocked(spark):
    rows = script([100, 90], dirn=1) + script([90], dirn=-1, bias="BEARISH", start="2024-01-02 10:20")
    rows += script([91], dirn=1, start="2024-01-02 10:30")
    # the latest stop is long, so the long re-entry after the flip is still cooling off
    assert [e for _, e in replay(spark, rows)] == ["ISSUED", "STOPPED", "ISSUED", "FLIPPED"]


def test_closed_market_blocks_issue_not_resolve(spark):
    assert replay(spark, script([100], open_=False)) == []
    rows = script([100]) + script([85], start="2024-01-02 10:10", open_=False)
    assert [e for _, e in replay(spark, rows)] == ["ISSUED", "STOPPED"]


def test_cooldown_is_per_key(spark):
    got = replay(spark, script([100, 90, 95], key="A") + script([100, 101, 102], key="B"))
    assert got == [("A", "ISSUED"), ("A", "STOPPED"), ("B", "ISSUED")]


def test_small_prices_keep_their_digits(spark):
    rows = script([0.0000098], risk=0.000001)
    r = latch.latch_batch(spark.createDataFrame(rows, IN)).first()
    assert r["entry"] == 0.0000098 and r["stop"] == 0.0000088 and 0 < r["stop"] < r["entry"] < r["tp1"] < r["tp2"]
    assert latch.fit(1234.5678) == 1234.57 and latch.fit(12.345678) == 12.3457 and latch.fit(0.12345678) == 0.123457


def test_short_levels_mirror(spark):
    r = latch.latch_batch(spark.createDataFrame(script([100], dirn=-1, bias="BEARISH"), IN)).first()
    assert (r["stop"], r["tp1"], r["tp2"]) == (110.0, 80.0, 70.0)


def test_batch_and_stream_agree(spark, tmp_path):
    rows = script([100, 120, 89, 100, 100, 100, 100, 100, 100, 131]) + script([50, 40, 41, 75], key="H")
    df = spark.createDataFrame(rows, IN)
    want = sorted((r["key"], str(r["ts"]), r["event"], r["entry"]) for r in latch.latch_batch(df).collect())
    src = tmp_path / "in"
    for i in range(3):  # three files, in time order
        lo, hi = i * 4, i * 4 + 4
        part = [r for k in ("G", "H") for r in [x for x in rows if x[0] == k][lo:hi]]
        spark.createDataFrame(part, IN).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(IN).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (
        latch.latch_stream(stream)
        .writeStream.format("memory").queryName("latched").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    q.stop()
    got = sorted((r["key"], str(r["ts"]), r["event"], r["entry"]) for r in spark.table("latched").collect())
    assert got == want


def test_ticks_to_signals_on_a_stream(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-03 15:00")
    hours = [("T", (t0 - pd.Timedelta(hours=300 - i)).to_pydatetime(), 90.0, 95.0, 4.0) for i in range(300)]
    hourly = spark.createDataFrame(hours, "symbol string, ts timestamp, ema50 double, ema200 double, atr double")
    prices = [100, 113, 105, 93, 93, 120]
    rows = [("T", (t0 + pd.Timedelta(minutes=7 * i)).to_pydatetime(), p - 0.05, p + 0.05) for i, p in enumerate(prices)]
    schema = "symbol string, ts timestamp, bid double, ask double"
    order = lambda df: [(str(r.ts), r.event, r.entry) for r in df.orderBy("ts", "event").collect()]
    want = order(live.live_signals(spark.createDataFrame(rows, schema), hourly))
    assert {"ISSUED", "TP1_HIT", "STOPPED"} <= {e for _, e, _ in want}
    for i in (0, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ticks.tick_stream(spark, str(tmp_path / "in"), 1)
    q = live.live_signals(stream, hourly).writeStream.format("memory").queryName("live_signals").outputMode("append")
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert order(spark.table("live_signals")) == want


def test_stream_bars_drop_late_ticks(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "symbol string, ts string, bid double, ask double").withColumn(
            "ts", F.col("ts").cast("timestamp")
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))

    put([("A", "2024-01-01 10:00:00", 1.0, 2.0), ("A", "2024-01-01 10:30:00", 3.0, 4.0), ("A", "2024-01-01 10:40:00", -1.0, 4.0)])
    q = (
        ticks.bars(ticks.quotes(ticks.tick_stream(spark, str(tmp_path / "t"), 1)))
        .writeStream.format("memory").queryName("hourbars").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    put([("A", "2024-01-01 12:00:00", 5.0, 6.0)])
    q.processAllAvailable()
    put([("A", "2024-01-01 10:59:00", 9.0, 9.0), ("A", "2024-01-01 14:00:00", 7.0, 8.0)])
    q.processAllAvailable()
    q.stop()
    got = [(r["open"], r["high"], r["low"], r["close"]) for r in spark.table("hourbars").orderBy("ts").collect()]
    assert got[0] == (1.5, 3.5, 1.5, 3.5)


def test_bars_take_corrections_over_a_restart(spark, tmp_path):
    schema = "symbol string, ts timestamp, bid double, ask double, rev long"
    rng = random.Random(4)
    t0 = pd.Timestamp("2024-01-01 10:00")
    batches, sent = [], []
    for b in range(6):  # each an hour; a tick is sent again, or anew with a higher revision, within ten minutes
        rows = []
        for m in range(0, 50, 2):
            for sym in "AB":
                at = (t0 + pd.Timedelta(hours=b, minutes=m)).to_pydatetime()
                told = [(sym, at, p - 0.5, p + 0.5, r) for r, p in ((None, 10.0), (1, 20.0 + rng.random()), (2, rng.choice([-1.0, 30.0, 31.0])))]
                rows += [r for r in told for _ in range(rng.randint(0, 2))]
        rng.shuffle(rows)
        batches.append(rows)
        sent += rows
    batches.append([("Z", pd.Timestamp("2024-01-02").to_pydatetime(), 1.0, 1.0, 0)])  # moves the watermark past the others
    seen = lambda df: sorted(tuple(r) for r in df.where("symbol <> 'Z'").collect())
    best = {}
    for sym, at, bid, ask, rev in sent:
        best[sym, at] = max(best.get((sym, at), (-9, 0, 0)), (-1 if rev is None else rev, bid, ask))
    want = {}
    for (sym, at), (_, bid, ask) in sorted(best.items()):
        if bid > 0 and ask > 0:
            want.setdefault((sym, at.replace(minute=0)), []).append((bid + ask) / 2)
    want = sorted((*k, p[0], max(p), min(p), p[-1], float(len(p))) for k, p in want.items())
    assert seen(ticks.corrected_bars(spark.createDataFrame(sent, schema))) == want
    src = str(tmp_path / "in")
    for part in (batches[:3], batches[3:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = ticks.corrected_bars(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert seen(spark.read.parquet(str(tmp_path / "out"))) == want


def test_market_calendar_edges_and_dst(spark):
    cases = {
        "2024-01-05 21:59": True, "2024-01-05 22:00": False,  # Friday 17:00 New York in winter
        "2024-07-05 20:59": True, "2024-07-05 21:00": False,  # an hour earlier in UTC in summer
        "2024-01-06 15:00": False, "2024-01-07 22:59": False, "2024-01-07 23:00": True,
        "2024-01-09 22:30": False, "2024-01-09 23:00": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "k string").withColumn("ts", F.col("k").cast("timestamp"))
    got = {r["k"]: r for r in sessions.market_status(sessions.add_clock(df)).collect()}
    assert {k: got[k]["market_open"] for k in cases} == cases
    assert str(got["2024-01-05 22:00"]["reopens"]) == "2024-01-07 18:00:00"


@pytest.mark.parametrize("market_open,expected", [(True, "poll"), (False, "stream")])
def test_stale_stream_gives_way_unless_market_is_shut(spark, market_open, expected):
    rows = [("A", "2024-01-01 10:00:00", 1.0, "stream", 0, market_open), ("A", "2024-01-01 10:00:20", 2.0, "poll", 1, market_open)]
    df = spark.createDataFrame(rows, "symbol string, t string, price double, source string, priority int, market_open boolean")
    df = df.withColumn("ts", F.col("t").cast("timestamp"))
    got = ticks.best_source(df, F.lit("2024-01-01 10:00:30").cast("timestamp")).first()
    assert got["source"] == expected


def test_state_is_plain_json():
    live = latch.Live(signal={"entry": 1.0}, last_stop=[1, 2.0], last_ts=3.0)
    from dataclasses import asdict

    assert latch.Live(**json.loads(json.dumps(asdict(live)))) == live
