"""Averages, source priority and history that a stream keeps by itself, against the batch and over restarts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.streaming import hours, live, priority, ticks

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State stores and files of small tables."""
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", keep)


TICK = "symbol string, ts timestamp, bid double, ask double"


def arriving(spark, df_rows, schema, folder, parts, seed=0):
    """Rows as files in time order, shuffled inside each file."""
    rng = np.random.default_rng(seed)
    rows = sorted(df_rows, key=lambda r: r[1])
    cuts = np.linspace(0, len(rows), parts + 1).astype(int)
    for a, b in zip(cuts, cuts[1:]):
        part = [rows[a + i] for i in rng.permutation(b - a)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(checkpoint)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def walks(hours_, per_hour=3, seed=5):
    rng = np.random.default_rng(seed)
    t0 = pd.Timestamp("2024-01-02 00:00")
    rows = []
    for sym, gap in (("A", 0), ("B", 40)):
        price = 100.0
        for h in range(hours_):
            if gap and 60 <= h < 60 + gap:
                continue  # no bars for a while, and averages that stay as they are
            for k in range(per_hour):
                price *= math.exp(rng.normal(0, 0.004))
                rows.append((sym, (t0 + pd.Timedelta(hours=h, minutes=19 * k, seconds=int(rng.integers(0, 1080)))).to_pydatetime(), price - 0.01, price + 0.01))
    return rows


def folded(df):
    return sorted((r.symbol, str(r.ts), r.status, r.bias, r.dirn, *(None if r[c] is None else round(r[c], 7) for c in ("ema50", "ema200", "atr", "risk"))) for r in df.collect())


def test_averages_on_the_stream_equal_the_batch(spark, tmp_path):
    rows = walks(30) + [("C", pd.Timestamp("2024-02-09 00:00").to_pydatetime(), 1.0, 1.1)]  # moves the watermark past the others
    batch = hours.self_biased(spark.createDataFrame(rows, TICK), min_bars=10)
    arriving(spark, rows, TICK, tmp_path / "in", 4)
    stream = hours.self_biased(ticks.tick_stream(spark, str(tmp_path / "in"), 1), min_bars=10)
    run(stream, "own_hours", tmp_path / "cp")
    want = [r for r in folded(batch) if r[0] != "C"]
    assert folded(spark.table("own_hours").where("symbol <> 'C'")) == want
    assert {r[2] for r in want} == {"ok", "short history", "no bars"}


def test_signals_survive_a_restart(spark, tmp_path):
    rows = walks(280, per_hour=2) + [("C", pd.Timestamp("2024-02-09 00:00").to_pydatetime(), 1.0, 1.1)]
    seen = lambda df: sorted((r.key, str(r.ts), r.event, round(r.entry, 6), round(r.stop, 6)) for r in df.collect())
    want = seen(live.live_signals(spark.createDataFrame(rows, TICK)))
    assert {"ISSUED", "STOPPED"} <= {e for _, _, e, _, _ in want} and {k for k, *_ in want} == {"A", "B"}
    whole = sorted(rows, key=lambda r: r[1])
    stop = len(whole) * 9 // 10  # between the first signals and the last
    found = []
    for i, part in enumerate((whole[:stop], whole[stop:])):
        arriving(spark, part, TICK, tmp_path / "in", 2, seed=i)
        stream = live.live_signals(ticks.tick_stream(spark, str(tmp_path / "in"), 1))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        found.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen(spark.read.parquet(str(tmp_path / "out"))) == want
    assert 0 < found[0] < found[1] == len(want)


FEED = "symbol string, ts timestamp, price double, source string, market_open boolean"
SOURCES = {"stream": 0, "poll": 1, "futures": 3}


def at(sec):
    return (pd.Timestamp("2024-01-02 10:00") + pd.Timedelta(seconds=sec)).to_pydatetime()


def changes(df):
    return sorted((r.symbol, str(r.ts), r.source, r.price, str(r.row_ts), r.reason) for r in df.collect())


def test_silence_alone_switches_the_source(spark, tmp_path):
    rows = [("A", at(0), 1.0, "poll", True), ("A", at(5), 2.0, "stream", True)]
    rows += [("B", at(s), 9.0, "stream", True) for s in (5, 60, 120, 900)]  # B alone moves time on
    arriving(spark, rows, FEED, tmp_path / "in", 3)
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(priority.source_changes(feed, SOURCES, stale=15, late="10 seconds"), "silent", tmp_path / "cp")
    got = changes(spark.table("silent").where("symbol = 'A'"))
    assert [(s, r) for _, _, s, _, _, r in got] == [("poll", "row"), ("stream", "row"), ("poll", "silence")]
    assert got[2][1] == "2024-01-02 10:00:20.001000" and got[2][3] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_source_changes_equal_batch_and_brute_force(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for sym in ("A", "B"):
        for src, gap in (("stream", 11), ("poll", 30), ("futures", 70)):
            for sec in np.cumsum(rng.integers(1, gap, 60)):
                rows.append((sym, at(int(sec)), float(rng.integers(1, 100)), src, bool(rng.random() < 0.8)))
    end = 10_000
    rows.append(("Z", at(end), 1.0, "poll", True))
    got = [r for r in changes(priority.source_changes(spark.createDataFrame(rows, FEED), SOURCES, stale=9)) if r[0] != "Z"]
    arriving(spark, rows, FEED, tmp_path / "in", 5, seed)
    feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(priority.source_changes(feed, SOURCES, stale=9, late="30 seconds"), f"changes{seed}", tmp_path / "cp")
    assert [r for r in changes(spark.table(f"changes{seed}")) if r[0] != "Z"] == got
    # by hand: the choice at every millisecond that matters
    for sym in ("A", "B"):
        mine = [r for r in rows if r[0] == sym]
        points = sorted({r[1] for r in mine} | {r[1] + pd.Timedelta(seconds=9.001).to_pytimedelta() for r in mine if r[3] == "stream"})
        now, want = None, []
        for t in points:
            pick = None
            for src in SOURCES:
                past = [r for r in mine if r[3] == src and r[1] <= t]
                if past:
                    r = max(past, key=lambda r: (r[1], r[2], r[4]))
                    if src != "stream" or not r[4] or (t - r[1]).total_seconds() <= 9:
                        pick = r
                        break
            if (pick and pick[3]) != now:
                now = pick and pick[3]
                want.append((str(t)[:23], now))
        assert [(ts[:23], s) for y, ts, s, *_ in got if y == sym] == want


# ── history ──────────────────────────────────────────────────────────────────
def test_replayed_batches_leave_no_duplicates(spark, tmp_path):
    from barloom.sources.history import History

    book = History(spark, str(tmp_path / "book"), "symbol string, n long")
    batch = lambda *ns: spark.createDataFrame([("A", n) for n in ns], "symbol string, n long")
    put = book.sink("q")
    all_ = lambda: sorted(r.n for r in book.read("q").collect())
    assert all_() == []
    put(batch(1, 2), 0)
    put(batch(3), 1)
    put(batch(3), 1)  # retried
    put(batch(), 2)
    put(batch(4), 3)
    book.put(batch(9), 0, "other")
    assert all_() == [1, 2, 3, 4]
    # a lost attempt without its _SUCCESS is not read, and its retry replaces it
    lost = tmp_path / "book/query=q/batches=000000000004-000000000004"
    batch(7, 8).write.parquet(str(lost))
    (lost / "_SUCCESS").unlink()
    assert all_() == [1, 2, 3, 4]
    put(batch(5), 4)
    assert all_() == [1, 2, 3, 4, 5]
    # killed between writing the compacted folder and deleting the old ones: nothing counts twice
    batch(1, 2, 3).write.parquet(str(tmp_path / "book/query=q/batches=000000000000-000000000001"))
    assert all_() == [1, 2, 3, 4, 5] and book.finished("q")[0] == (0, 1)
    put(batch(1, 2), 0)  # replayed after compaction
    assert all_() == [1, 2, 3, 4, 5]
    book.compact("q", 3)
    assert book.finished("q") == [(0, 3), (4, 4)] and all_() == [1, 2, 3, 4, 5]
    assert sorted(r.n for r in book.read("q", "other").collect()) == [1, 2, 3, 4, 5, 9]


def test_a_stream_killed_inside_a_batch_writes_it_once(spark, tmp_path):
    from barloom.sources.history import History

    schema = "symbol string, ts timestamp, price double, source string, market_open boolean"
    rows = [("A", at(s), float(s), "poll", True) for s in range(8)]
    arriving(spark, rows, schema, tmp_path / "in", 4)
    book = History(spark, str(tmp_path / "book"), schema)
    fail = {2}

    def sink(df, batch):
        book.put(df, batch, "q")
        if batch in fail:
            fail.discard(batch)
            raise RuntimeError("lost after writing")

    def go():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = feed.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="lost after writing"):
        go()
    go()
    assert sorted(r.price for r in book.read("q").collect()) == [r[2] for r in rows]


# ── growing panel ────────────────────────────────────────────────────────────
def test_extending_equals_a_full_run(spark, tmp_path):
    from barloom.plans import growing, panels

    rng = np.random.default_rng(2)
    frames = []
    for sym, lo, hi in (("A", 0, 400), ("B", 0, 395), ("C", 300, 400), ("D", 394, 400), ("E", 0, 200)):
        n = hi - lo
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        frames.append(pd.DataFrame({"symbol": sym, "ts": pd.date_range("2020-01-01", periods=400, freq="D")[lo:hi], "open": close * 0.99, "high": close * 1.02, "low": close * 0.97, "close": close, "volume": rng.integers(1, 99, n).astype(float)}))
    bars = spark.createDataFrame(pd.concat(frames, ignore_index=True))
    cut = [pd.Timestamp("2020-01-01") + pd.Timedelta(days=d) for d in (0, 385, 392, 400)]
    days = lambda a, b: bars.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
    path = str(tmp_path / "store")
    growing.start(days(cut[0], cut[1]), path, min_rows=3)
    growing.extend(days(cut[1], cut[2]), path, min_rows=3)
    growing.extend(days(cut[2], cut[3]), path, min_rows=3)
    growing.extend(days(cut[2], cut[3]), path, min_rows=3)  # again, after a failure
    want = panels.technical_panel(bars, min_rows=3).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    got = growing.read(spark, path).drop("date").toPandas()[want.columns].sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9, check_dtype=False)
    # what it read: tails, whose length does not grow with the history
    held = growing.state(spark, path, cut[3].date())
    sizes = {r.symbol: (r.n, r.rows) for r in held.select("symbol", F.size("tail").alias("n"), "rows").collect()}
    assert sizes == {"A": (100, 400), "B": (100, 395), "C": (100, 100), "D": (6, 6), "E": (100, 200)}
    with pytest.raises(ValueError, match="no snapshot"):
        growing.extend(days(cut[0], cut[1]), path)
