"""Removal of long repeats with a run-length index.

A byte goes if it lies in a `length`-byte string that starts anywhere else too, in the same document or another.

1. Every window of `length` bytes has an anchor: the smallest of its GRAM-byte rolling hashes, the rightmost of equal ones.
   Equal windows have equal anchors at equal places, so the consecutive windows of one anchor, a fragment of fewer than
   2 * length bytes, need to be compared only with fragments of the same anchor hash.
2. Anchors that occur once are done.  Where all fragments of an anchor are equal, all their windows are repeats.
3. Otherwise the distinct fragments of an anchor are brought together, whole groups at a time, and a run-length index over
   them streams the matching statistics; windows whose match is `length` or longer are repeats.
4. A group of more than GROUP_FRAGMENTS distinct fragments is too large for one task and is settled by the hash of each window.

Anchors are summed before they are shuffled.  Texts are shuffled once, compressed, for the fragments and the removal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.rlbwt import RunLengthIndex
from barloom.llm.winnowing import window_minima

GRAM = 64
GROUP_FRAGMENTS = 4_000
CHUNK_BYTES = 600_000
_WIDTH = 1 << 20  # `at` holds first window * _WIDTH + further windows
_SPAN = 1 << 31  # a span is start * _SPAN + end


def fragments_of(raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text index, anchor hash, fragment hash, first window, further windows) of every anchor in the texts."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    starts = np.cumsum(size) - size
    codes = np.frombuffer(b"".join(raw), np.uint8)
    full = size >= length
    if not full.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    gram = min(GRAM, length)
    prefix = common.prefix_hash(codes)
    at = np.arange(len(codes) - gram + 1)
    grams = common.slice_hash(prefix, at, at + gram)
    _, least = window_minima(grams, length - gram + 1)
    n = size[full] - length + 1
    window = common.ranges(starts[full], n)
    owner = np.repeat(np.flatnonzero(full), n)
    chosen = least[window].astype(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    k = np.flatnonzero(new)
    lo = window[k]
    hi = window[np.append(k[1:], len(window)) - 1]
    fragment = common.mix(common.slice_hash(prefix, lo, hi + length) + (chosen[k] - lo).astype(np.uint64) * common.BASE)
    return owner[k], grams[chosen[k]], fragment, lo - starts[owner[k]], hi - lo


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an identity of their own: the id (null as the smallest long) and a hash of the text."""
    return common.keyed_texts(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.hash("text").alias("tag"), "doc_id", "text"
    )


def occurrences(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in common.light(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            for lo, hi in common.chunks(raw):
                doc, anchor, fragment, first, more = fragments_of(raw[lo:hi], length)
                take = pa.array(doc + lo)
                cols = [pa.array(anchor.view(np.int64)), pa.array(fragment.view(np.int64)), b.column("key").take(take), b.column("tag").take(take), pa.array(first * _WIDTH + more)]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "fragment", "key", "tag", "at"])

    long = rows.where(F.octet_length("text") >= length).select("key", "tag", "text")
    return long.mapInArrow(run, "anchor long, fragment long, key long, tag int, at long")


def _compressed(rows: DataFrame, length: int) -> DataFrame:
    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for b in common.light(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            cols = [b.column(c) for c in ("key", "tag", "doc_id")]
            cols += [pa.array([len(r) for r in raw], pa.int64()), pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "tag", "doc_id", "n_bytes", "packed"])

    return rows.where(F.octet_length("text") >= length).mapInArrow(run, "key long, tag int, doc_id long, n_bytes long, packed binary")


def _cut_out(cells: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """The bytes of one fragment of each cell."""
    wanted = cells.groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "fragment", "at", "several", "huge")).alias("cells"))

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            out = []
            for size, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("n_bytes", "packed", "cells"))):
                raw = codec.decompress(packed, decompressed_size=size, asbytes=True)
                for c in wanted:
                    first, more = divmod(c["at"], _WIDTH)
                    out.append((c["anchor"], c["fragment"], c["several"], c["huge"], raw[first : first + more + length]))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["anchor", "fragment", "several", "huge", "raw"])

    once = packed.join(wanted, ["key", "tag"]).select("n_bytes", "packed", "cells")
    return once.mapInArrow(run, "anchor long, fragment long, several boolean, huge boolean, raw binary").dropDuplicates(["anchor", "fragment"])


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


RANGES = "anchor long, fragment long, ranges array<struct<first:int,last:int>>"


def _indexed(cut: DataFrame, length: int) -> DataFrame:
    """Repeated windows of each fragment, from one run-length index per chunk of whole groups."""

    def settle(rows: list) -> pa.RecordBatch:
        index = RunLengthIndex([r[3] for r in rows])
        repeated = index.matching_statistics(length) >= length
        out = []
        for (anchor, fragment, several, raw), start in zip(rows, index.starts.tolist()):
            windows = len(raw) - length + 1
            found = [(0, windows - 1)] if several else _runs(repeated[start : start + windows])
            if found:
                out.append((anchor, fragment, [{"first": a, "last": b} for a, b in found]))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
        cols = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["anchor", "fragment", "ranges"])

    def run(batches):
        held: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "fragment", "several", "raw"))):
                if size > CHUNK_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield settle(held)

    rows = cut.where("not huge").select("anchor", "fragment", "several", "raw")
    return rows.repartition("anchor").sortWithinPartitions("anchor", "fragment").mapInArrow(run, RANGES)


def _by_window(cut: DataFrame, length: int) -> DataFrame:
    """The same for huge groups: windows are counted by their hash."""

    def run(batches):
        for b in batches:
            for anchor, fragment, several, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "fragment", "several", "raw"))):
                prefix = common.prefix_hash(np.frombuffer(raw, np.uint8))
                at = np.arange(len(raw) - length + 1)
                n = len(at)
                cols = [np.full(n, anchor), np.full(n, fragment), at.astype(np.int32), common.slice_hash(prefix, at, at + length).view(np.int64), np.full(n, 1 + several, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor", "fragment", "place", "window", "copies"])

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def joined(places: pd.Series) -> pd.Series:
        return pd.Series([_runs(np.bincount(p) > 0) for p in places])

    windows = cut.where("huge").select("anchor", "fragment", "several", "raw").mapInArrow(run, "anchor long, fragment long, place int, window long, copies long")
    twice = windows.groupBy("anchor", "window").agg(F.sum("copies").alias("n")).where("n > 1").select("anchor", "window")
    found = windows.join(twice, ["anchor", "window"]).groupBy("anchor", "fragment").agg(F.collect_list("place").alias("places"))
    return found.select("anchor", "fragment", joined("places").alias("ranges"))


def repeated_spans(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(compressed texts of at least `length` bytes, spans per text): the spans cover every repeated window, unmerged."""
    rows = _keyed(docs, id_col, text_col)
    found = common.written(occurrences(rows, length))
    groups = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("fragment").alias("a"), F.max("fragment").alias("b")).where("n > 1")
    # written, so that the join below deals both sides itself and AQE can split an anchor with very many occurrences
    groups = common.written(groups)
    shared = found.join(groups.select("anchor", (F.col("a") != F.col("b")).alias("differ")), "anchor")
    first, more = F.floor(F.col("at") / _WIDTH), F.col("at") % _WIDTH
    span = lambda lo, hi: ((lo * _SPAN) + hi + length).cast("long").alias("span")
    shared = common.written(shared)
    even = shared.where("not differ").select("key", "tag", span(first, first + more))
    uneven = shared.where("differ")
    one = uneven.groupBy("anchor", "fragment").agg(F.count("*").alias("n"), F.min(F.struct("key", "tag", "at")).alias("of"))
    one = one.select("anchor", "fragment", (F.col("n") > 1).alias("several"), "of.*")
    huge = one.groupBy("anchor").agg((F.count("*") > GROUP_FRAGMENTS).alias("huge"))
    packed = _compressed(rows, length)
    cut = common.written(_cut_out(one.join(huge, "anchor"), packed, length))
    ranges = common.written(_indexed(cut, length).unionByName(_by_window(cut, length)))
    some = uneven.join(ranges, ["anchor", "fragment"]).select("key", "tag", first.alias("lo"), F.explode("ranges").alias("r"))
    spans = even.unionByName(some.select("key", "tag", span(F.col("lo") + F.col("r.first"), F.col("lo") + F.col("r.last"))))
    return packed, spans.groupBy("key", "tag").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal runs [start, end) covered by the spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(divmod(s, _SPAN) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends, kept) of every document.

    `starts` and `ends` are the removed byte runs, `kept` the bytes that stay (as they are: a cut may fall inside a code
    point).  Null texts count as empty; texts shorter than `length` lose nothing.  Rows that repeat an id and a text are
    copies of one another and lose what they share.
    """
    packed, spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            out = []
            for doc_id, size, packed, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "packed", "spans"))):
                raw = codec.decompress(packed, decompressed_size=size, asbytes=True)
                gone = merged(spans or [])
                edges = [0, *(x for g in gone for x in g), size]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, size, size - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [g[0] for g in gone], [g[1] for g in gone], kept))
            longs = pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), longs, longs, pa.binary())
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in schema.split(", ")])

    long = packed.join(spans, ["key", "tag"], "left").select("doc_id", "n_bytes", "packed", "spans").mapInArrow(run, schema)
    raw = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")
    short = common.keyed_texts(docs, id_col, text_col).where(F.octet_length("text") < length)
    short = short.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2(raw, 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"), raw.alias("kept"),
    )
    return long.unionByName(short)


def drop_repeats(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated bytes taken out of the text; rows and other columns stay, a null text stays null.

    What a cut leaves of a split code point goes too.
    """
    _, spans = repeated_spans(docs, length=length, id_col=id_col, text_col=text_col)
    key, tag, list_ = (common.free_name(docs, c) for c in ("key", "tag", "spans"))

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans):
            if s is None or t is None:
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            edges = [0, *(x for g in merged([int(v) for v in s]) for x in g), len(raw)]
            out.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2])))
        return pd.Series(out, dtype=object)

    text = F.col(text_col).cast("string")
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias(key), F.hash(F.coalesce(text, F.lit(""))).alias(tag))
    marks = spans.select(F.col("key").alias(key), F.col("tag").alias(tag), F.col("spans").alias(list_))
    return keyed.join(marks, [key, tag], "left").withColumn(text_col, without(text, F.col(list_))).select(*docs.columns)
