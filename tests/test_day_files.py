"""Day files of a feed as a source: which files are opened, what a stream takes, and what it takes after a restart."""

import datetime as dt
import gzip
import json

import pytest

from barloom.sources import day_files, feeds


def line(symbol, day, close):
    at = int(dt.datetime.fromisoformat(day).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    return json.dumps({"T": symbol, "t": at, "o": 1, "h": 9, "l": 1, "c": close, "v": 3})


def put(folder, day, closes, zipped=False):
    text = "\n".join(line(f"S{i}", day, c) for i, c in enumerate(closes)) + "\n\n"
    raw = text.encode()
    (folder / f"{day}.json{'.gz' * zipped}").write_bytes(gzip.compress(raw) if zipped else raw)


@pytest.fixture
def folder(spark, tmp_path):
    day_files.register(spark)
    f = tmp_path / "pulls"
    f.mkdir()
    return f


def closes(df):
    return sorted((r.symbol, str(r.ts)[:10], r.close) for r in feeds.normalise_feed(df).collect())


def test_a_date_filter_opens_only_its_files(spark, folder):
    for i, day in enumerate(("2024-01-02", "2024-01-03", "2024-01-04")):
        put(folder, day, [1.0 + i, 2.0 + i], zipped=i == 1)
    (folder / "notes.txt").write_text("not a day")
    (folder / "2024-01-05.json").write_bytes(b"\xff\xfe not UTF-8")  # whoever opens it fails

    def load(path=folder, **days):
        return spark.read.format("feed_days").options(**days).load(str(path))

    want = [("S0", "2024-01-03", 2.0), ("S0", "2024-01-04", 3.0), ("S1", "2024-01-03", 3.0), ("S1", "2024-01-04", 4.0)]
    some = load(since="2024-01-03", until="2024-01-04")
    assert closes(some.where("value LIKE '%S1%'")) == want[2:]
    assert closes(some.where("day = '2024-01-04'")) == [want[1], want[3]] and closes(some) == want  # a filter does not stay
    assert closes(load(f"file://{folder}", since="2024-01-03", until="2024-01-03")) == [want[0], want[2]]
    assert load(until="2020-01-01").count() == 0
    with pytest.raises(Exception, match="utf-8"):
        load().count()


def test_empty_folders_and_days_with_two_files(spark, folder):
    load = lambda: spark.read.format("feed_days").load(str(folder))
    assert load().count() == 0 and [f.name for f in load().schema] == ["day", "value"]
    (folder / "2024-01-02.json").write_text("")
    assert load().count() == 0
    put(folder, "2024-01-02", [1.0], zipped=True)
    with pytest.raises(Exception, match="two files of 2024-01-02"):
        load().count()


def test_long_files_come_in_batches(folder, monkeypatch):
    monkeypatch.setattr(day_files, "BATCH", 400)
    put(folder, "2024-01-02", range(50))
    (part,) = day_files.days_of(str(folder))
    found = list(day_files.rows(part))
    assert len(found) > 5 and sum(b.num_rows for b in found) == 50
    assert [json.loads(v)["c"] for b in found for v in b.column(1).to_pylist()] == list(range(50))


def test_a_stream_takes_each_day_once_over_a_restart(spark, folder, tmp_path):
    def run():
        days = spark.readStream.format("feed_days").load(str(folder))
        q = feeds.normalise_feed(days).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        q = q.option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sum(p.numInputRows for p in q.recentProgress)

    put(folder, "2024-01-02", [1.0, 2.0])
    put(folder, "2024-01-03", [3.0])
    assert run() == 3 and run() == 0
    put(folder, "2024-01-04", [4.0], zipped=True)
    assert run() == 1
    got = sorted((str(r.ts)[:10], r.symbol, r.close) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2024-01-02", "S0", 1.0), ("2024-01-02", "S1", 2.0), ("2024-01-03", "S0", 3.0), ("2024-01-04", "S0", 4.0)]
