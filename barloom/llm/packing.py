"""Packing token sequences by best-fit decreasing.

A document longer than a window is first cut into full windows.  What is left of each document goes, longest first, into
the open window with the least room that still takes it; a segment tree over the possible remaining capacities finds
that window in log2(window) steps, and a new window is opened where none fits.

Placing is independent in groups of about `group_docs` documents, dealt by a hash of the document, so no task sees more
than a group and a hot source or a very long document changes nothing.  A group leaves at most a few windows half empty.
Only the small rows that describe pieces are shuffled, never texts (nor ids, unless `with_ids` asks for them).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, token_ids

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows in their range of capacities."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def put(self, room: int, window_id: int) -> None:
        self.open.setdefault(room, []).append(window_id)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (room, window) with the least room of at least `need`."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length; equal lengths are placed in the order given."""
    tree = RoomTree(window)
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            room, bin_id = window, used
            used += 1
        else:
            room, bin_id = found
        bins[i], offsets[i] = bin_id, window - room
        if room > need:
            tree.put(room - need, bin_id)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, *, window: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: full windows of each document, then its rest."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in common.chunks(texts):
                flat, counts = token_ids.encode(texts[lo:hi], tokenizer, end_id)
                flat = flat.astype("<u4")
                n_pieces = -(-counts // window)
                doc = np.repeat(np.arange(hi - lo), n_pieces)
                first = np.cumsum(n_pieces) - n_pieces
                start = (np.arange(len(doc)) - first[doc]) * window
                length = np.minimum(window, counts[doc] - start)
                at = (np.cumsum(counts) - counts)[doc] + start
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                cols = [b.column("doc_id").slice(lo, hi - lo).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), counts[doc]))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    offsets = pa.array(np.append(at, at[-1] + length[-1]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = PIECE + (", ids array<int>" if with_ids else "")
    return common.keyed_texts(docs, id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, group_docs: int = 4096, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their place: (doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    `start` counts the ids of the document before the piece, `offset` the ids of the sequence before it.  A null or empty
    text is its end id alone.  Repeated rows are packed as often as they stand there; null ids stay null.
    """
    groups = common.blocks_for(docs.count(), group_docs)
    rows = pieces(docs, tokenizer, window=window, end_id=end_id, with_ids=with_ids, id_col=id_col, text_col=text_col)
    schema = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        pdf["sequence_id"] = pdf["_group"].to_numpy(np.int64) * (1 << 32) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="_group")

    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)).alias("_group")
    return rows.select("*", group).groupBy("_group").applyInPandas(place, schema)
