import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import levels, text
from barloom.sources import feeds


def test_csv_spread_points(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text("dt,open,high,low,close,tick_volume,spread\n2024-01-01T00:00:00Z,1,2,0.5,1.5,10,550\n")
    r = feeds.read_bars_csv(spark, str(f), "X").first()
    assert r["spread_usd"] == 0.55 and r["volume"] == 10.0 and str(r["ts"]) == "2024-01-01 00:00:00"


def test_panel_filters_reach_the_scan(spark, bars, tmp_path):
    feeds.write_table(bars, str(tmp_path / "p"))
    df = feeds.read_panel(spark, str(tmp_path / "p"), symbols=["B"], start="2020-01-02").select("symbol", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "symbol" in plan
    assert "volume" not in plan.split("ReadSchema")[1]
    assert df.count() == 120 - 24


def test_nan_becomes_null(spark, tmp_path):
    pdf = pd.DataFrame({"symbol": ["A"], "ts": pd.to_datetime(["2024-01-01"]), "open": [float("nan")], "high": [float("inf")], "low": [1.0], "close": [1.0], "volume": [1.0]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "p"))
    r = feeds.read_panel(spark, str(tmp_path / "p")).first()
    assert r["open"] is None and r["high"] is None and r["low"] == 1.0


def test_feed_without_vwap_or_price(spark):
    rows = [('{"T":"X:AUSD","t":1704067200000,"o":1,"h":2,"l":1,"c":1.5,"v":3}',), ('{"T":"X:BUSD","t":1704067200000,"o":1,"h":2,"l":1,"v":3}',)]
    got = feeds.normalise_feed(spark.createDataFrame(rows, "value string")).collect()
    assert [(r["symbol"], r["vwap"]) for r in got] == [("X:AUSD", 1.5)]


def test_sinks_round_trip(spark, bars, tmp_path):
    scored = bars.withColumn("date", F.to_date("ts"))
    feeds.write_panel(scored, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("date = '2020-01-01'").count() == 24 * 3
    ev = bars.select("symbol", "ts").withColumn("event", F.lit("ISSUED"))
    feeds.append_history(ev, str(tmp_path / "h"))
    feeds.append_history(ev.limit(0), str(tmp_path / "h"))
    h = spark.read.parquet(str(tmp_path / "h"))
    assert feeds.last_events(h, 20).count() == 20
    assert feeds.last_events(h, 20, per=["symbol"]).count() == 60


def test_lexicon_and_mentions(spark):
    news = spark.createDataFrame(
        [(1, "Profit surge, then a loss", "x", "BRK-B up"), (2, "eloss Aap AAPL.", "x", ""), (3, "nothing", "x", "")],
        "doc_id long, title string, source string, summary string",
    )
    n = text.scored(news)
    assert {r["doc_id"]: r["score"] for r in n.collect()} == {1: 1 / 3, 2: 0.0, 3: 0.0}
    names = spark.createDataFrame([("AAPL", "AAPL"), ("BRK-B", "BRK-B"), ("A", "A")], "symbol string, name string")
    hits = text.mentions(n, names)
    assert sorted(tuple(r) for r in hits.collect()) == [(1, "BRK-B"), (2, "AAPL")]
    assert [r["doc_id"] for r in text.generic_items(n, hits).collect()] == [3]


def test_names_of_several_words(spark):
    rows = [(1, "Blue Harbour opens", "x", ""), (2, "Blue, Harbour", "x", "the Blue Harbours"), (3, "Blue", "x", "a Blue Harbour"),
            (4, "Deep Blue", "x", "Blue Harbour Lines"), (5, "Ablue Harbour", "x", "A&B Co. of"), (6, "", "x", "")]
    n = text.scored(spark.createDataFrame(rows, "doc_id long, title string, source string, summary string"))
    names = spark.createDataFrame([("P", "Blue Harbour"), ("Q", "Blue"), ("R", "A&B Co"), ("T", "Blue Harbour Lines"), ("E", "."), ("N", None)], "symbol string, name string")
    found = {}
    for r in text.mentions(n, names).collect():
        found.setdefault(r.symbol, set()).add(r.doc_id)
    assert found == {"P": {1, 3, 4}, "Q": {1, 2, 3, 4}, "R": {5}, "T": {4}}


def test_symbols_of_one_name_share_its_news(spark):
    rows = [(i, f"Acme item {i}", "x", "profit" if i % 2 else "Other loss") for i in range(8)]
    n = text.scored(spark.createDataFrame(rows, "doc_id long, title string, source string, summary string"))
    names = spark.createDataFrame([("A1", "Acme"), ("A2", "Acme"), ("B", "Other"), ("C", "Other"), ("C", "Acme"), ("D", "D")], "symbol string, name string")
    hits = text.mentions(n, names).collect()
    assert sorted(r.doc_id for r in hits if r.symbol == "A2") == list(range(8)) and len(hits) == 8 * 3 + 4
    got = {r.symbol: r for r in text.aggregate_news(n, text.name_hits(n, names), names).collect()}
    assert {s: r.news_count for s, r in got.items()} == {"A1": 8, "A2": 8, "B": 4, "C": 8}
    assert got["A1"][1:] == got["A2"][1:] == got["C"][1:] and got["B"].news_score == -1 and got["B"].headline == "Acme item 0"
    assert got["A2"].snippets == [f"Acme item {i} (x)" for i in range(5)]


def test_long_and_short_levels_are_ordered(spark):
    rows = [(p, rsi, p * e) for p in (0.5, 20.0, 900.0) for rsi in (20.0, 50.0, 80.0) for e in (0.7, 0.97, 1.0, 1.03, 1.4)]
    df = spark.createDataFrame(rows, "price double, rsi double, ema9 double").withColumns(
        {
            "ema21": F.col("ema9") * 0.99, "ema50": F.col("ema9") * 0.97, "ema200": F.col("ema9") * 0.9,
            "bb_lower": F.col("price") * 0.95, "bb_upper": F.col("price") * 1.05, "atr": F.col("price") * 0.02,
            "hi52": F.lit(None).cast("double"),
        }
    )
    for r in levels.add_long_levels(df).collect():
        assert r["stop"] < r["entry"] < r["target_1"] < r["target_2"] and r["target_1"] > r["price"]
        assert r["entry"] >= r["price"] * 0.93
    for r in levels.add_short_levels(df).collect():
        assert r["stop"] > r["entry"] > r["target_1"] >= r["target_2"] and r["target_1"] < r["price"]
