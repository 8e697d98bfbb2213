"""Removal of word windows that a document with a smaller id has too, behind a count-min prefilter.

1. Documents are packed into chunks of a few megabytes, written once.  Each chunk makes its own count-min sketch of its windows (two
   rows of cells, counters up to two, documents counted and not places), kept sparse and cut into slices of the hash range.
2. The sketches of a slice are merged by adding their cells.  The answer to a chunk is one bit per cell it sent: whether two documents are
   estimated there.  A window whose cells are all marked may be repeated; no other window can be.
3. Only those windows go on, with 96 bits of hash and the least id of the chunk.  They are grouped exactly, slice by slice; the
   answer is one bit each: whether a smaller id has it elsewhere.
4. The words of the marked windows are taken out of the chunk's texts.

The number of slices grows with the table and the cells of a slice are fixed, so the sketch keeps its accuracy at every size and no task or
driver holds more than one slice of it.  A window that very many documents share is one cell per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, words

WINDOW = 13
ROWS = 2

_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Grid:
    """The hash range in 2**bits slices, each with ROWS rows of 2**cell_bits cells."""

    bits: int
    cell_bits: int

    @classmethod
    def of(cls, text_bytes: int, slice_bytes: int) -> Grid:
        """Slices of at most `slice_bytes` of text; two bytes of text have a cell, so a window has three or more."""
        return cls(max(0, (text_bytes - 1) // slice_bytes).bit_length(), max(8, (slice_bytes - 1).bit_length() - 1))

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << self.cell_bits) - 1)


class Windows:
    """The windows of a chunk of texts, and the distinct ones in the order of their hash."""

    def __init__(self, raw: list[bytes], ids: np.ndarray, known: np.ndarray, window: int) -> None:
        self.words = w = words.split(raw)
        self.size = window
        n = np.where(known, np.maximum(w.counts - window + 1, 0), 0)
        self.at = common.ranges(w.first, n)  # first word of each window; texts come in the order of their ids
        up, down = common.powers(len(w.hashes) + 1)
        prefix = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(w.hashes * up[:-1], out=prefix[1:])
        first = common.mix((prefix[self.at + window] - prefix[self.at]) * down[self.at])
        np.cumsum(common.mix(w.hashes + _OTHER) * up[:-1], out=prefix[1:])
        second = common.mix((prefix[self.at + window] - prefix[self.at]) * down[self.at])
        order = np.argsort(first, kind="stable")
        self.id = np.repeat(ids, n)
        self.order, first, second, owner = order, first[order], (second[order] >> np.uint64(32)).astype(np.uint32), self.id[order]
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1  # distinct window of each window in `order`
        self.hash, self.hash2, self.least = first[begin], second[begin], owner[begin]
        self.several = owner[np.append(begin[1:], len(order)) - 1] > self.least if len(begin) else np.zeros(0, bool)

    def cells(self, grid: Grid) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(cells, whether two documents are there, cell number of each distinct window) of every row of the sketch."""
        part = self.hash >> np.uint64(64 - grid.cell_bits - grid.bits)
        other = (part & ~grid.mask) | (common.mix(self.hash ^ _OTHER) & grid.mask)
        out = []
        for key in (part, other):
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.ones(len(key), bool)
            new[1:] = sorted_[1:] != sorted_[:-1]
            begin = np.flatnonzero(new)
            place = np.empty(len(key), np.int64)
            place[order] = np.cumsum(new) - 1
            many = np.add.reduceat(1 + self.several[order].astype(np.int64), begin) > 1 if len(begin) else np.zeros(0, bool)
            out.append((sorted_[begin], many, place))
        return out

    def candidates(self, grid: Grid, answers: list[dict] | None) -> np.ndarray:
        """Numbers of the distinct windows that the merged sketch estimates in two documents."""
        if not len(self.hash):
            return np.zeros(0, np.int64)
        fine = np.ones(len(self.hash), bool)
        replies = {a["slice"]: a["bits"] for a in answers}
        rows = self.cells(grid)
        marks = [np.zeros(len(r[0]), bool) for r in rows]
        for s, cuts in _slices([r[0] for r in rows], grid.cell_bits):
            flat = _unpack(replies[s], sum(b - a for a, b in cuts))
            for m, (a, b) in zip(marks, cuts):
                m[a:b], flat = flat[: b - a], flat[b - a :]
        for (_, _, place), m in zip(rows, marks):
            fine &= m[place]
        return np.flatnonzero(fine)


def _slices(keys: list[np.ndarray], shift: int):
    """(slice, index range of each of the sorted key arrays) of all slices that occur in the first."""
    tops = [(k >> np.uint64(shift)) if shift < 64 else np.zeros(len(k), np.uint64) for k in keys]
    for s in np.unique(tops[0]).tolist():
        yield int(s), [tuple(np.searchsorted(t, [s, s + 1]).tolist()) if shift < 64 else (0, len(t)) for t in tops]


def _pack(flags: np.ndarray) -> bytes:
    return _squeezed(np.packbits(flags).tobytes())


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(_loose(raw), np.uint8), count=n).view(bool)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _loose(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), asbytes=True)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high ones of small numbers then take no room."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sketch(rows: list[tuple[np.ndarray, np.ndarray]], mask: np.uint64) -> bytes:
    """One slice of a sparse sketch: (cells, marks) per row."""
    head = np.array([len(c) for c, _ in rows], "<u4").tobytes()
    body = [_planes(np.diff((c & mask).astype("<u4"), prepend=np.uint32(0))) + np.packbits(m).tobytes() for c, m in rows]
    return _squeezed(head + b"".join(body))


def _read_sketch(raw: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = _loose(raw)
    out, at = [], 4 * ROWS
    for n in np.frombuffer(raw, "<u4", ROWS).tolist():
        cells = np.cumsum(_unplanes(raw[at : at + 4 * n], "<u4"))
        at += 4 * n
        out.append((cells, np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n)))
        at += -(-n // 8)
    return out


CHUNKS = "chunk long, ids array<long>, sizes array<long>, texts binary"


def packed(docs: DataFrame, chunk_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Chunks of documents in ascending order of ids (null last)."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in common.chunks(texts, chunk_chars):
                order = sorted(range(lo, hi), key=lambda i: (ids[i] is None, ids[i] or 0))
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in order]
                mine = [ids[i] for i in order]
                longs = pa.list_(pa.int64())
                row = zip(([number], [mine], [list(map(len, raw))], [_squeezed(b"".join(raw))]), (pa.int64(), longs, longs, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], [c.split()[0] for c in CHUNKS.split(", ")])
                number += 1

    return common.keyed_texts(docs, id_col, text_col).mapInArrow(run, CHUNKS)


def _windows(raw: list[bytes], ids: list[int | None], window: int) -> Windows:
    known = np.array([i is not None for i in ids], bool)
    return Windows(raw, np.array([i or 0 for i in ids], np.int64), known, window)


def _open(row: dict, window: int) -> tuple[Windows, list[int | None]]:
    joined, at, raw = _loose(row["texts"]), 0, []
    for n in row["sizes"]:
        raw.append(joined[at : at + n])
        at += n
    return _windows(raw, row["ids"], window), row["ids"]


def _sketches(chunks: DataFrame, window: int, grid: Grid) -> DataFrame:
    """(slice, chunk, cells): the sketch of every chunk, cut into slices."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                rows = _open(row, window)[0].cells(grid)
                out = [
                    (s, row["chunk"], _sketch([(c[a:z], m[a:z]) for (c, m, _), (a, z) in zip(rows, cuts)], grid.mask))
                    for s, cuts in _slices([r[0] for r in rows], grid.cell_bits)
                ]
                cols = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], ["slice", "chunk", "cells"])

    return chunks.mapInArrow(run, "slice int, chunk long, cells binary")


ANSWER = "chunk long, slice int, bits binary"
_ANSWER = [c.split()[0] for c in ANSWER.split(", ")]


def _answers(table: pa.Table, bits: list[bytes]) -> pa.Table:
    return pa.Table.from_arrays([table.column("chunk"), table.column("slice"), pa.array(bits, pa.binary())], _ANSWER)


def _merged(grid: Grid):
    def merge(table: pa.Table) -> pa.Table:
        """All sketches of one slice -> for each whether two documents are estimated at its cells."""
        counters = np.zeros((ROWS, 1 << grid.cell_bits), np.uint8)
        for raw in table.column("cells"):
            for counter, (cells, many) in zip(counters, _read_sketch(raw.as_py())):
                counter[cells] = np.minimum(counter[cells] + many + 1, 2)
        out = []
        for raw in table.column("cells"):
            out.append(_pack(np.concatenate([counter[cells] > 1 for counter, (cells, _) in zip(counters, _read_sketch(raw.as_py()))])))
        return _answers(table, out)

    return merge


def _group(table: pa.Table) -> pa.Table:
    """All windows asked for in one slice -> for each whether a chunk names a smaller id."""
    counts = np.array(table.column("n").to_pylist(), np.int64)
    first, second, ids = (np.empty(int(counts.sum()), k) for k in ("<u8", "<u4", "<i8"))
    at = 0
    for raw, n in zip(table.column("windows"), counts.tolist()):
        raw, to = _loose(raw.as_py()), at + n
        first[at:to] = np.cumsum(_unplanes(raw[: 8 * n], "<u8"), dtype=np.uint64)
        second[at:to] = _unplanes(raw[8 * n : 12 * n], "<u4")
        ids[at:to] = np.frombuffer(raw, "<i8", offset=16 * n)[_unplanes(raw[12 * n : 16 * n], "<u4")]
        at = to
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    f, s = first[order], second[order]
    new[1:] = (f[1:] != f[:-1]) | (s[1:] != s[:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.empty(len(order), bool)
    smaller[order] = least[np.cumsum(new) - 1] < ids[order]
    cuts = np.cumsum(counts)
    return _answers(table, [_pack(smaller[c - n : c]) for c, n in zip(cuts.tolist(), counts.tolist())])


def _by_chunk(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("slice", "bits")).alias(name))


def _asked(chunks: DataFrame, marks: DataFrame, window: int, grid: Grid) -> DataFrame:
    """(slice, chunk, n, windows) of the windows that may be repeated."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                found, _ = _open(row, window)
                some = found.candidates(grid, row["marks"])
                hashes, out = found.hash[some], []
                for s, ((a, z),) in _slices([hashes], 64 - grid.bits):
                    part = some[a:z]
                    ids, which = np.unique(found.least[part], return_inverse=True)
                    steps = np.diff(found.hash[part], prepend=np.uint64(0))  # ascending
                    body = _planes(steps) + _planes(found.hash2[part]) + _planes(which.astype("<u4")) + ids.tobytes()
                    out.append((s, row["chunk"], z - a, _squeezed(body)))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["slice", "chunk", "n", "windows"])

    rows = chunks.join(_by_chunk(marks, "marks"), "chunk")
    return rows.mapInArrow(run, "slice int, chunk long, n long, windows binary")


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeated_windows(docs: DataFrame, *, window: int = WINDOW, chunk_chars: int = 4_000_000, slice_bytes: int = 1 << 25, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every document.

    A word goes if one of the windows of `window` consecutive words that cover it also starts in a document with a smaller id; windows are
    those of the input.  `kept` joins the words that stay by one space.  A null text has no words.  A row without an id is neither
    smaller nor larger than another: it keeps its words and takes none from others; so do rows of one id among each other.

    `chunk_chars` are the code points of a chunk (one longer text is a chunk of its own) and `slice_bytes` the text that a slice of
    the sketch stands for, which takes as many bytes of a task's memory.  A chunk sends a row to each slice, so where the
    slices are more than some thousands, larger slices and chunks make fewer and longer rows.
    """
    size = common.keyed_texts(docs, id_col, text_col).agg(F.sum(F.octet_length("text"))).first()[0]
    grid = Grid.of(size or 0, slice_bytes)
    chunks = common.written(packed(docs, chunk_chars, id_col, text_col))
    marks = common.written(_sketches(chunks, window, grid).groupBy("slice").applyInArrow(_merged(grid), ANSWER))
    asked = _asked(chunks, marks, window, grid)
    smaller = common.written(asked.groupBy("slice").applyInArrow(_group, ANSWER))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                found, ids = _open(row, window)
                some = found.candidates(grid, row["marks"])
                replies = {a["slice"]: a["bits"] for a in row["smaller"] or []}
                elsewhere = np.zeros(len(found.hash), bool)
                for s, ((a, z),) in _slices([found.hash[some]], 64 - grid.bits):
                    elsewhere[some[a:z]] = _unpack(replies[s], z - a)
                gone = np.empty(len(found.at), bool)
                gone[found.order] = elsewhere[found.group] | (found.id[found.order] > found.least[found.group])
                edge = np.zeros(len(found.words.starts) + 1, np.int32)
                edge[found.at[gone]] += 1
                edge[found.at[gone] + window] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                before = np.append(0, np.cumsum(~stay))
                removed = before[found.words.last] - before[found.words.first]
                cols = [pa.array(ids, pa.int64()), pa.array(found.words.counts), pa.array(removed), pa.array(found.words.kept(stay), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in KEPT.split(", ")])

    rows = chunks.join(_by_chunk(marks, "marks"), "chunk", "left").join(_by_chunk(smaller, "smaller"), "chunk", "left")
    return rows.mapInArrow(run, KEPT)


#: The same for windows of 13 words of `documents`, with the hash of what stays.
TWIN = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM texts)
), firsts AS (
  SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (w) WHERE least < doc_id
), placed AS (
  SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN gone USING (r, place) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
