"""Token counts by heap-and-linked-list byte-pair merging.

A piece of text starts as a doubly linked list of byte symbols.  A heap holds the adjacent pairs that have a merge rank;
the lowest (rank, position) is popped again and again, stale entries are skipped, the pair becomes one symbol and its two
new neighbours are pushed.  The count is the number of initial symbols minus the number of merges: no token ids are made.

Counting is narrow work: documents stay where they were read and nothing is shuffled.  A piece that a worker has already
met is looked up, so the heap runs once for each distinct piece.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, pretokens


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others moved to 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(moved)) for b in range(256)]


class Merges:
    """Ranks of the merges in a tokenizer file, by numbered symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.number: dict[str, int] = {}
        number = self.number
        self.byte = [number.setdefault(s, len(number)) for s in byte_symbols()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = tuple(number.setdefault(x, len(number)) for x in (a, b))
            self.ranks.setdefault(key, (rank, number.setdefault(a + b, len(number))))

    def count(self, piece: str) -> int:
        """Tokens of one piece."""
        symbol = [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbol)
        if n < 2:
            return n
        ranks = self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = ranks.get((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue
            symbol[i], symbol[j] = merged, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((merged, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], merged))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return n - merges


@functools.cache
def _table(path: str) -> pretokens.PieceTable:
    merges = Merges(path)
    return pretokens.PieceTable(lambda pieces: [(merges.count(p),) for p in pieces])


def counts_of(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each whole text; kept pieces live as long as the worker."""
    out = np.zeros(len(texts), np.int64)
    known = _table(path)
    for lo, hi in common.chunks(texts):
        joined, codes, starts, ends, doc, special = pretokens.split(texts[lo:hi])
        plain = ~special
        rows = known.rows_of(joined, codes, starts[plain], ends[plain])
        counts = known.flat[known.starts[rows]]
        out[lo:hi] = np.bincount(doc[plain], counts, minlength=hi - lo) + np.bincount(doc[special], minlength=hi - lo)
    return out


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    `tokenizer` is the path of a byte-level BPE file, the same on every executor.  Null and empty texts have no bytes and
    no tokens; null ids stay null; repeated rows give repeated rows; an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            counts = counts_of(b.column("text").to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = common.keyed_texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def n_tokens(text, tokenizer: str):
    """Column with the token count of a text column, by the same merging."""

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        return pd.Series(counts_of([v or "" for v in values], tokenizer))

    return count(F.coalesce(text, F.lit("")))
