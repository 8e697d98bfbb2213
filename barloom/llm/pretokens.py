"""Splitting texts into the pieces that byte-pair merging works on, as array operations, and a table of known pieces.

The rule is that of the byte-level vocabulary (public_tokenizers.PATTERN):

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point has one of four classes (letter, number, space, other).  A piece is a run of one class with at most one
blank before it; runs of white space give their last character away; a contraction cuts a run of letters.  All of this
can be told from neighbouring code points, so a chunk of texts is split at once, without a regular expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import regex

from barloom.llm import common

LETTER, NUMBER, SPACE, OTHER, BREAK, SPECIAL = range(6)
_BREAK, _SPECIAL = "\ud800", "\ud801"  # lone surrogates: no valid text holds them
LONG = 64  # longer pieces are compared by their text, shorter ones by a 64-bit hash


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, by the same engine as the pattern."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            out[lo : hi + 1] = np.where(out[lo : hi + 1] == OTHER, kind, out[lo : hi + 1]) if hi - lo + 1 == len(m[0]) else out[lo : hi + 1]
            if hi - lo + 1 != len(m[0]):
                out[[ord(c) for c in m[0]]] = kind
    out[0x1C:0x20] = OTHER  # the vocabulary's library does not take these controls as white space
    out[ord(_BREAK)], out[ord(_SPECIAL)] = BREAK, SPECIAL
    return out


def split(texts: list[str], special: str = "<|endoftext|>"):
    """The pieces of `texts`: (joined text, code points, starts, ends, text index, is special), in order.

    `special` inside a text is one piece of its own, as the library has it by default.
    """
    whole = [t.replace(special, _BREAK + _SPECIAL + _BREAK) if special in t else t for t in texts]
    joined = _BREAK.join(whole) + _BREAK
    codes = common.code_points(joined)
    kind = classes()[codes]
    n = len(codes)
    left = np.empty_like(kind)
    left[0], left[1:] = BREAK, kind[:-1]
    right = np.empty_like(kind)
    right[-1], right[:-1] = BREAK, kind[1:]
    space = kind == SPACE
    # a white-space character that another class follows belongs to no run of white space
    last = space & (right != SPACE) & (right != BREAK) & (right != SPECIAL)
    glued = last & (codes == 32)  # a blank that the next piece takes
    start = kind != left
    start |= last
    start[1:] &= ~glued[:-1]
    # contractions: an apostrophe that begins a piece, then s, t, m, d, re, ve or ll
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        a = codes[np.minimum(quote + 1, n - 1)]
        b = codes[np.minimum(quote + 2, n - 1)]
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        for hit, width in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            start[at + 1] = False
            if width == 3:
                start[at + 2] = False
            after = at + width
            start[after[kind[after] != BREAK]] = True
            # a blank after the contraction is already a start; a letter after it begins a new piece
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    which = kind[starts]
    doc_breaks = np.cumsum([w.count(_BREAK) + 1 for w in whole])
    keep = which != BREAK
    breaks_before = np.cumsum(kind == BREAK)[starts[keep]]
    doc = np.searchsorted(doc_breaks, breaks_before, side="right")
    return joined, codes, starts[keep], ends[keep], doc, which[keep] == SPECIAL


class PieceTable:
    """Values of known pieces.  `compute` gets the texts of new pieces and returns their arrays of ids (or counts)."""

    def __init__(self, compute: Callable[[list[str]], list], most: int = 500_000) -> None:
        self.compute, self.most = compute, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)  # row of the key at the same place
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.long: dict[str, int] = {}

    def _add(self, new: list) -> np.ndarray:
        """Append values; returns their row numbers."""
        first = len(self.lengths)
        lengths = np.fromiter((len(v) for v in new), np.int64, len(new))
        flat = np.concatenate([np.asarray(v, np.int32) for v in new]) if new else np.zeros(0, np.int32)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, flat])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, starts])
        return np.arange(first, first + len(new))

    def rows_of(self, joined: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each piece in `lengths`, `starts` and `flat`; new pieces are computed once."""
        if len(self.lengths) > self.most:
            self.clear()
        out = np.empty(len(starts), np.int64)
        short = ends - starts <= LONG
        hashes = common.slice_hash(common.prefix_hash(codes), starts[short], ends[short])
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        row = np.empty(len(distinct), np.int64)
        row[known] = self.rows[at[known]]
        if not known.all():
            s, e = starts[short][first[~known]], ends[short][first[~known]]
            row[~known] = self._add(self.compute([joined[a:b] for a, b in zip(s.tolist(), e.tolist())]))
            keys = np.concatenate([self.keys, distinct[~known]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], np.concatenate([self.rows, row[~known]])[order]
        out[short] = row[inverse]
        for i in np.flatnonzero(~short):
            piece = joined[starts[i] : ends[i]]
            if piece not in self.long:
                self.long[piece] = int(self._add(self.compute([piece]))[0])
            out[i] = self.long[piece]
        return out
