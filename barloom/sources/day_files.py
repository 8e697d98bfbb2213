"""Pulled day files of a grouped feed as a source of its own: `spark.read.format("feed_days")`, also for `readStream`.

A folder holds one file per day, `2024-01-05.json` or `2024-01-05.json.gz`, with one feed row a line.  The options `since` and `until`
choose files before any is opened; a stream takes the days that are new since its last batch.  Paths are those that pyarrow can open.

    day_files.register(spark)
    bars = feeds.normalise_feed(spark.read.format("feed_days").option("since", "2024-01-05").load("s3://lake/pulls"))

Days are options and not pushed filters, because Spark 4.1 keeps what a filter made of a Python source in the frame: after
`df.where(day).count()` a plain `df.count()` gives the days of the filter alone.  A `where` on `day` is right but opens every file.
"""

from __future__ import annotations

import datetime as dt
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

NAME = re.compile(r"(\d{4}-\d{2}-\d{2})\.json(\.gz)?")
SCHEMA = "day date, value string"
BATCH = 8 << 20  # bytes of text in an Arrow batch


@dataclass
class Day(ds.InputPartition):
    path: str
    day: dt.date


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is one of this machine."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def days_of(path: str) -> list[Day]:
    """The day files of a folder in order of time; other names are passed over, a day with two files is an error."""
    where, folder = opened(path)
    found: dict[dt.date, Day] = {}
    for info in where.get_file_info(fs.FileSelector(folder)):
        named = NAME.fullmatch(info.base_name)
        if named is None or not info.is_file:
            continue
        day = dt.date.fromisoformat(named[1])
        if day in found:
            raise ValueError(f"{path} has two files of {day}: which one counts is not known")
        found[day] = Day(f"{path.rstrip('/')}/{info.base_name}", day)
    return [found[d] for d in sorted(found)]


@dataclass
class Chosen:
    """The days of a folder from `first` to `last`."""

    path: str
    first: dt.date
    last: dt.date

    def days(self) -> list[Day]:
        return [d for d in days_of(self.path) if self.first <= d.day <= self.last]


def rows(part: Day) -> Iterator[pa.RecordBatch]:
    """The lines of a day file, a few megabytes at a time; blank lines are none."""
    where, name = opened(part.path)
    schema = pa.schema([("day", pa.date32()), ("value", pa.string())])

    def batch(lines: list[str]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part.day] * len(lines), pa.date32()), pa.array(lines, pa.string())], schema=schema)

    with where.open_input_stream(name, compression="detect") as raw:
        lines, size = [], 0
        for line in io.TextIOWrapper(io.BufferedReader(raw), "utf-8", newline="\n"):
            line = line.rstrip("\r\n")
            if not line.strip():
                continue
            lines.append(line)
            size += len(line)
            if size >= BATCH:
                yield batch(lines)
                lines, size = [], 0
        if lines:
            yield batch(lines)


class FeedDays(ds.DataSource):
    """Columns: day, value.  Options: path; `since` and `until`, both days taken in.  A loaded frame keeps its list of files."""

    @classmethod
    def name(cls) -> str:
        return "feed_days"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return Reader(self.chosen())

    def streamReader(self, schema: StructType) -> ds.DataSourceStreamReader:
        return StreamReader(self.chosen())

    def chosen(self) -> Chosen:
        first, last = (dt.date.fromisoformat(self.options.get(o, d)) for o, d in (("since", "0001-01-01"), ("until", "9999-12-31")))
        return Chosen(self.options["path"], first, last)


class Reader(ds.DataSourceReader):
    def __init__(self, chosen: Chosen) -> None:
        self.chosen = chosen

    def partitions(self) -> list[Day]:
        return self.chosen.days()

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        # a table without partitions is read as one of None
        yield from rows(partition) if partition is not None else ()


class StreamReader(ds.DataSourceStreamReader):
    """An offset is the last day there is, which the folder alone tells, so a restart cannot step back.

    A file has to be whole when it gets its name, and days have to come in order: one before the last day taken is never read.
    """

    def __init__(self, chosen: Chosen) -> None:
        self.chosen = chosen

    def initialOffset(self) -> dict:
        return {"day": ""}

    def latestOffset(self) -> dict:
        return {"day": max((d.day.isoformat() for d in self.chosen.days()), default="")}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [d for d in self.chosen.days() if start["day"] < d.day.isoformat() <= end["day"]]

    def read(self, partition: Day) -> Iterator[pa.RecordBatch]:
        yield from rows(partition)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its executors need this package, as they do for the stateful operators."""
    spark.dataSource.register(FeedDays)
