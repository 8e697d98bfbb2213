"""Plans that must not move wide rows or whole texts: what a step shuffles is told from its physical plan."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.operators import cross, evaluate, series
from barloom.operators.cross import calendar, rebalance_dates
from barloom.operators.series import plain
from barloom.plans import growing, panels
from barloom.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df) -> list[str]:
    """The exchanges of the plan, before AQE changed it."""
    return [x for x in plan(df).split("== Initial Plan ==")[-1].splitlines() if "Exchange " in x]


@pytest.fixture
def no_small_tables(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bars_of(spark, lengths):
    day = dt.datetime(2020, 1, 1)
    rows = []
    for k, n in enumerate(lengths):
        for i in range(n):
            p = 50 + k + (i * (7 + k)) % 11 - 0.1 * (i % 17)
            rows.append((f"S{k}", day + dt.timedelta(days=i), p, p + 1 + i % 3, p - 1 - i % 2, p + (i * 5) % 7 / 10, 100.0 + i % 13))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_wide_rows_are_not_dealt_by_date(spark, no_small_tables):
    panel = bars_of(spark, [60, 60]).withColumn("row_no", F.dayofyear("ts"))
    cal = calendar(panel)
    out = evaluate.point_in_time(panel, plain(), rebalance_dates(panel, 20, 5, 5), cal, 20, (2, 5), 5)
    assert "SortMergeJoin" not in plan(out) and out.count() > 0


def test_newest_rows_are_those_of_the_whole_panel(spark):
    bars = bars_of(spark, [1, 30, 100, 101, 260]).cache()
    newest = panels.newest_rows(bars)
    assert "WindowGroupLimit" not in plan(newest)
    whole = panels.indicator_panel(bars)
    ends = whole.join(bars.groupBy("symbol").agg(F.max("ts").alias("ts")), ["symbol", "ts"])
    pick = sorted(whole.columns)
    assert sorted(map(tuple, newest.select(pick).collect()), key=str) == sorted(map(tuple, ends.select(pick).collect()), key=str)


def test_snapshots_take_their_tails_without_a_sort(spark):
    rows = panels.indicator_panel(bars_of(spark, [5, 130]), with_state=True).localCheckpoint()
    snap = growing._snapshot(rows)
    assert "Window" not in plan(snap)
    assert {r.symbol: (len(r.tail), r.rows) for r in snap.collect()} == {"S0": (5, 5), "S1": (growing.TAIL, 130)}


def test_words_of_texts_are_not_shuffled_to_a_few_names(spark, no_small_tables, monkeypatch):
    rows = [(1, "Blue Harbour opens Acme"), (2, "Acme"), (2, "Blue Harbour"), (3, "none"), (None, "Acme and Blue Harbour")]
    news = spark.createDataFrame(rows, "doc_id long, combined string")
    names = spark.createDataFrame([("P", "Blue Harbour"), ("Q", "Acme"), ("R", "Acme"), ("R", "Blue Harbour")], "symbol string, name string")
    hits = text.name_hits(news, names)
    found = {(1, "Blue Harbour"), (1, "Acme"), (2, "Acme"), (2, "Blue Harbour"), (None, "Acme")}
    assert plan(hits).count("Generate") == 1 and "BroadcastHashJoin" in plan(hits)
    assert sorted(map(tuple, hits.collect()), key=str) == sorted(found, key=str)
    pairs = sorted(map(tuple, text.mentions(news, names).collect()), key=str)
    of = {"P": {"Blue Harbour"}, "Q": {"Acme"}, "R": {"Acme", "Blue Harbour"}}
    assert pairs == sorted({(d, s) for d, n in found for s, has in of.items() if n in has}, key=str)
    monkeypatch.setattr(text, "BROADCAST_NAMES", 0)
    many = text.name_hits(news, names)
    assert "BroadcastHashJoin" not in plan(many) and sorted(map(tuple, many.collect()), key=str) == sorted(found, key=str)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_walk_forward_moves_bars_once_in_tasks_of_bounded_size(spark, monkeypatch):
    bars = bars_of(spark, [20, *[90] * 40])
    bars = bars.unionByName(bars.where("symbol = 'S1'").withColumn("symbol", F.lit(None).cast("string")))
    seen, settled, real = [], [], evaluate.settle

    def panel_of(b):
        seen.append(b)
        return b.withColumn("row_no", F.row_number().over(plain().ordered()))

    monkeypatch.setattr(series, "TASK_ROWS", 50)
    monkeypatch.setattr(evaluate, "settle", lambda df: settled.append(df) or real(df))
    out = evaluate.walk_forward(bars, panel_of, plain(), 20, 5, (2, 5))
    assert seen[0].rdd.getNumPartitions() == 40 * 90 // 50
    assert len(moves(seen[0])) == 1
    # symbols and dates are settled, and the result; bars are not
    assert [c for df in settled[:-1] for c in df.columns if c in ("open", "close", "volume")] == []
    days = {f"S{k}": {r.ts: r.close for r in bars.where(f"symbol = 'S{k}'").collect()} for k in (1, 40)}
    start = dt.datetime(2020, 1, 1)
    for k, close in days.items():
        got = {r.date: (r.close, r.fwd2, r.fwd5) for r in out.where(F.col("symbol") == k).collect()}
        at = [start + dt.timedelta(days=i) for i in range(20, 90 - 6, 5)]
        assert got == {d: (close[d], *[pytest.approx(close[d + dt.timedelta(days=h)] / close[d] - 1) for h in (2, 5)]) for d in at}
    assert {r.symbol for r in out.select("symbol").distinct().collect()} == {f"S{k}" for k in range(1, 41)}


def test_rank_ics_move_rows_once_for_all_horizons(spark, no_small_tables, monkeypatch):
    rows = [
        (f"f{g % 2}" if g < 5 else None, g, None if i % 11 == 3 else float(i * 7 % (5 + g)), None if i % 5 == g else i * 3 % 17 / 10, None if g == 4 else -1.0 * (i * i % 13))
        for g in range(6) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "feature string, date int, value double, a double, b double")
    by = ["feature", "date"]
    got = cross.rank_ics(df, by, "value", ["a", "b"])
    assert len(moves(got)) == 1
    found = {(r.feature, r.date, r.horizon): (r.n, r.ic) for r in got.collect()}
    for h in ("a", "b"):
        for g in range(6):
            pdf = df.where((F.col("date") == g) & F.col("value").isNotNull() & F.col(h).isNotNull()).toPandas()
            key = (f"f{g % 2}" if g < 5 else None, g, h)
            if len(pdf) > 10 and pdf["value"].nunique() > 3:
                assert found.pop(key) == (len(pdf), pytest.approx(pdf["value"].rank().corr(pdf[h].rank())))
    assert not found
    few = [("f", 1, float(i % 3), float(i)) for i in range(30)] + [("f", 2, float(i % 4), float(i)) for i in range(11)]
    ic = cross.rank_ic(spark.createDataFrame(few, "feature string, date int, value double, a double"), by, "value", "a")
    assert ic.columns == [*by, "n", "ic"] and [r.date for r in ic.collect()] == [2]
    monkeypatch.setattr(cross, "LARGE_GROUP", 5)
    large = {(r.feature, r.date, r.horizon): (r.n, r.ic) for r in cross.rank_ics(df.where("date < 5"), by, "value", ["a", "b"]).collect()}
    small = {(r.feature, r.date, r.horizon): (r.n, pytest.approx(r.ic)) for r in got.where("date < 5").collect()}
    assert large == small


def test_composites_do_not_unpivot_or_join_the_panel(spark, no_small_tables, monkeypatch):
    rows = [
        (dt.date(2020, 1, 1 + g), f"S{i}", None if i == 4 else float(i * 5 % 11), None if i in (4, 6) else float(i * (3 + g) % 7), i * 7 % 13 / 10)
        for g in range(4) for i in range(30)
    ]
    df = spark.createDataFrame(rows, "date date, symbol string, x double, y double, fwd double")
    settled, real = [], evaluate.settle
    monkeypatch.setattr(evaluate, "settle", lambda d: settled.append(d) or real(d))
    fit, p = evaluate.sign_fit(df, {"x": 0.6, "y": 0.4}, "fwd")
    assert "SortMergeJoin" not in plan(settled[-1]) and [x for x in moves(settled[-1]) if "symbol" in x] == []
    assert p.columns == ["date", "symbol", "x", "y", "fwd", "late", "corrected", "icweighted"] and p.count() == 120
    f = {r.feature: r for r in fit.collect()}
    pdf = df.toPandas()
    for c in ("x", "y"):
        by = pdf.groupby("date")[c]
        pdf[f"z_{c}"] = (pdf[c] - by.transform("mean")) / by.transform("std")
    want = {(r.date, r.symbol): r for r in pdf.itertuples()}
    for r in p.collect():
        w = want[r.date, r.symbol]
        for out, weight in (("corrected", "weight"), ("icweighted", "ic_weight")):
            terms = [z * f[c].sign * f[c][weight] for c, z in (("x", w.z_x), ("y", w.z_y)) if not math.isnan(z)]
            assert r[out] == (pytest.approx(sum(terms)) if terms else None)
    assert p.where("symbol = 'S4' AND corrected IS NULL").count() == 4


def test_quintiles_count_a_date_where_it_is_ranked(spark, no_small_tables, monkeypatch):
    rows = [(d, f"S{i}", None if i == 3 else float(i % 6)) for d in ("a", "b", None) for i in range(13)]
    df = spark.createDataFrame(rows, "date string, symbol string, score double")
    got = cross.quintiles(df, "date", "score")
    assert "Join" not in plan(got) and len(moves(got)) == 1
    assert got.count() == 24 and got.where("date IS NULL").count() == 0
    monkeypatch.setattr(cross, "LARGE_GROUP", 5)
    assert same(got, cross.quintiles(df, "date", "score").select(got.columns))


def test_weekly_bars_carry_each_price_once(spark, tmp_path):
    day = dt.datetime(2020, 1, 6)
    rows = [
        (s, "N", "O", o, n, None if o == 9 else day + dt.timedelta(days=o % 9), None if n == 4 else float(n % 3), p)
        for s in (1, 2, None) for o in range(10) for n, p in ((1, 10.0 + o), (2, 30.0 - o), (4, 5.0), (3, None), (6, 7.0))
    ]
    kind = "l_suppkey long, l_returnflag string, l_linestatus string, l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    li = tables._lineitem_prices(spark, str(tmp_path)).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.date_trunc("week", "l_shipdate").alias("ts"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "price").alias("o"), "price", "l_quantity",
    )
    got = tables.bars_li_w(spark, str(tmp_path))
    assert "min_by" not in plan(got) and "concat" not in plan(got).split("Exchange ")[-1]
    assert same(got, tables._ohlc(li, ["symbol", "ts"], "price", F.col("o"), "l_quantity")) and got.count() == 9
