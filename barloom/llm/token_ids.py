"""Token ids of whole texts from the tokenizers library, asked once for each distinct piece."""

from __future__ import annotations

import functools
import os

import numpy as np

from barloom.llm import common, pretokens


@functools.cache
def _table(path: str) -> tuple[pretokens.PieceTable, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return pretokens.PieceTable(encode), tokenizer.token_to_id("<|endoftext|>")


def encode(texts: list[str], path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, ids per text), as add_special_tokens=False gives them; `end_id` closes each text.

    A byte-level vocabulary never merges across pieces, so the ids of a text are those of its pieces.
    """
    known, special_id = _table(path)
    flats, counts = [], []
    for lo, hi in common.chunks(texts):
        joined, codes, starts, ends, doc, special = pretokens.split(texts[lo:hi])
        n = hi - lo
        extra = 0 if end_id is None else n
        length = np.ones(len(starts) + extra, np.int64)
        plain = np.flatnonzero(~special)
        rows = known.rows_of(joined, codes, starts[plain], ends[plain])
        if extra:
            place = np.arange(len(starts)) + doc  # one end id after the pieces of each text before it
            ends_at = np.searchsorted(doc, np.arange(n), side="right") + np.arange(n)
        else:
            place = np.arange(len(starts))
        length[place[plain]] = known.lengths[rows]
        stop = np.cumsum(length)
        flat = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        single = np.zeros(len(length), bool)
        single[place[special]] = True
        flat[(stop - length)[single]] = special_id or 0
        if extra:
            flat[(stop - length)[ends_at]] = end_id
        flat[common.ranges((stop - length)[place[plain]], known.lengths[rows])] = known.flat[
            common.ranges(known.starts[rows], known.lengths[rows])
        ]
        per = np.bincount(doc, length[place], minlength=n).astype(np.int64)
        counts.append(per + (1 if extra else 0))
        flats.append(flat)
    if not flats:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(flats), np.concatenate(counts)
