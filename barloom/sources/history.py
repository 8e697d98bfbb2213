"""Signal history that holds every micro-batch of a streaming query once, whatever is replayed.

    <path>/query=<name>/batches=<first>-<last>/   parquet files and _SUCCESS

A micro-batch overwrites the folder of its own number, so a retried batch replaces what a lost attempt left.  Compaction writes the
folder of a range and then deletes those inside it; readers take the widest finished folders only, so no state between counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAME = re.compile(r"batches=(\d+)-(\d+)$")


class History:
    """`schema` is that of the rows, as text or type; `path` any folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, query: str, first: int, last: int) -> str:
        return f"{self.path}/query={query}/batches={first:012d}-{last:012d}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def finished(self, query: str) -> list[tuple[int, int]]:
        """Ranges of batches with a finished folder, none inside another, in order."""
        fs, top = self._fs(f"{self.path}/query={query}")
        if not fs.exists(top):
            return []
        found = []
        for entry in fs.listStatus(top):
            name = _NAME.search(entry.getPath().toString())
            if name and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                found.append((int(name[1]), int(name[2])))
        out: list[tuple[int, int]] = []
        for first, last in sorted(found, key=lambda r: (r[0], -r[1])):
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def put(self, rows: DataFrame, batch: int, query: str) -> None:
        """Store one micro-batch; a batch that a compacted folder holds already is left alone."""
        if any(first <= batch <= last and first < last for first, last in self.finished(query)):
            return
        rows.write.mode("overwrite").parquet(self._folder(query, batch, batch))

    def sink(self, query: str) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda rows, batch: self.put(rows, batch, query)

    def read(self, *queries: str) -> DataFrame:
        """All rows of the named queries with their `query`."""
        parts = []
        for query in queries:
            folders = [self._folder(query, *r) for r in self.finished(query)]
            if folders:
                parts.append(self.spark.read.schema(self.schema).parquet(*folders).withColumn("query", F.lit(query)))
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn("query", F.lit(None).cast("string"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self, query: str, upto: int) -> None:
        """Join the batches up to `upto` (finished ones only) to one folder of evenly sized files."""
        ranges = [r for r in self.finished(query) if r[1] <= upto]
        if len(ranges) < 2:
            return
        first, last = ranges[0][0], ranges[-1][1]
        rows = self.spark.read.schema(self.schema).parquet(*[self._folder(query, *r) for r in ranges])
        rows.hint("rebalance").write.mode("overwrite").parquet(self._folder(query, first, last))
        for r in ranges:
            fs, at = self._fs(self._folder(query, *r))
            fs.delete(at, True)
