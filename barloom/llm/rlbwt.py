"""Run-length index of a bounded text made of fragments: run-compressed Burrows-Wheeler transform with sampled run ends.

The transform is kept as runs (character, length); suffix positions are kept only at the first and the last row of each
run.  The longest match of a position with any other position obeys M[p] >= M[p - 1] - 1, with equality wherever a row and its
neighbour continue one run, so the matches measured at run ends give all matching statistics by one pass over the text.
"""

from __future__ import annotations

import numpy as np

from barloom.llm import common

SEPARATOR = 0


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` codes (0 to 256) that follow, by prefix doubling."""
    n = len(codes)
    width = 7
    padded = np.concatenate([codes.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << 9) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if width >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[: n - width] += rank[width:]
        width *= 2


class RunLengthIndex:
    def __init__(self, fragments: list[bytes]) -> None:
        """Matches never reach over the end of a fragment."""
        raw = np.frombuffer(b"".join(f + b"\0" for f in fragments), np.uint8)
        sizes = np.fromiter((len(f) + 1 for f in fragments), np.int64, len(fragments))
        self.starts = np.cumsum(sizes) - sizes
        self.codes = raw.astype(np.int16) + 1
        self.codes[self.starts + sizes - 1] = SEPARATOR
        self.end = np.repeat(self.starts + sizes - 1, sizes)
        order = suffix_order(self.codes, int(sizes.max(initial=1)))
        bwt = self.codes[order - 1]
        head = np.ones(len(bwt), bool)
        head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == SEPARATOR)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(bwt)) - 1
        self.run_chars, self.run_lengths = bwt[first], last - first + 1
        # sampled run ends, each with the suffix in the neighbouring row
        self.first_samples = np.stack([order[first[1:]], order[first[1:] - 1]])
        self.last_samples = np.stack([order[last[:-1]], order[last[:-1] + 1]])
        self.prefix = common.prefix_hash(self.codes.astype(np.uint32))

    @property
    def runs(self) -> int:
        return len(self.run_chars)

    def transform(self) -> np.ndarray:
        """The Burrows-Wheeler transform, unrolled."""
        return np.repeat(self.run_chars, self.run_lengths)

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern, by backward search over the runs."""
        total = np.bincount(self.run_chars, self.run_lengths, minlength=258).astype(np.int64)
        below = np.cumsum(total) - total
        begins = np.cumsum(self.run_lengths) - self.run_lengths
        lo, hi = 0, int(self.run_lengths.sum())

        def rank(c: int, row: int) -> int:
            run = int(np.searchsorted(begins, row, side="right")) - 1
            before = int(self.run_lengths[:run][self.run_chars[:run] == c].sum())
            return before + (row - int(begins[run]) if row > begins[run] and self.run_chars[run] == c else 0)

        for byte in reversed(pattern):
            c = byte + 1
            lo, hi = int(below[c]) + rank(c, lo), int(below[c]) + rank(c, hi)
            if lo >= hi:
                return 0
        return hi - lo

    def _common(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Length of the common prefix of suffixes a and b inside their fragments; 0 if below `least`."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        out = np.zeros(len(a), np.int64)
        could = np.flatnonzero(most >= least)
        could = could[self._same(a[could], b[could], np.full(len(could), least))]
        lo, hi = np.full(len(could), least), most[could]
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self._same(a[could], b[could], mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        out[could] = lo
        return out

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return common.slice_hash(self.prefix, a, a + n) == common.slice_hash(self.prefix, b, b + n)

    def matching_statistics(self, least: int = 1) -> np.ndarray:
        """For each position the longest match with another position, streamed from the samples; below `least` it may be less."""
        reach = np.zeros(len(self.codes), np.int64)  # how far a match known so far goes
        for at, other in (self.first_samples, self.last_samples):
            found = self._common(at, other, least)
            np.maximum.at(reach, at, np.where(found > 0, at + found, 0))
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)
