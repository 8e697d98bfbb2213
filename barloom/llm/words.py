"""Words of whole texts as arrays: where they stand, a 64-bit hash of each, and texts of the words that stay."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from barloom.llm import common

#: A word is a run of anything but blanks and the controls 9 to 13.
PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at once; a longer word is hashed whole.
PIECE = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Words:
    codes: np.ndarray  # the bytes of all texts, one line feed after each
    starts: np.ndarray  # of every word in `codes`
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # number of the first word of each text
    last: np.ndarray  # and of the word after its last

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first

    def kept(self, keep: np.ndarray) -> list[str]:
        """The wanted words of each text, joined by one space."""
        starts, ends = self.starts[keep], self.ends[keep]
        edge = np.zeros(len(self.codes) + 2, np.int8)
        edge[starts] = 1
        edge[ends + 1] -= 1  # the blank after a word goes along
        inside = np.cumsum(edge[:-2], dtype=np.int8).view(bool)
        out = np.where(_BLANK[self.codes], np.uint8(32), self.codes)[inside].tobytes()
        size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
        before = np.concatenate([[0], np.cumsum(keep)])
        cuts = size[before[np.append(self.first, self.last[-1:])]].tolist()
        return [out[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(cuts, cuts[1:])]


def split(raw: list[bytes]) -> Words:
    """Words of texts given as UTF-8."""
    codes = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.diff(_BLANK[codes].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        hashes[at:to] = common.slice_hash(common.prefix_hash(codes[lo:hi]), starts[at:to] - lo, ends[at:to] - lo)
        at = to
    stops = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    last = np.searchsorted(starts, stops)
    return Words(codes, starts, ends, hashes, np.append(0, last[:-1])[: len(raw)], last)
