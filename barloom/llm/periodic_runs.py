"""Maximal periodic runs of words, found by catching squares while words are appended.

Level k watches periods from 2**k to 2**(k+1) - 1.  Whenever a block of 2**k words that starts at a multiple of 2**k is complete, it
becomes a catcher.  An appended word closes one suffix of 2**k words a level, and exactly one catcher lies at a distance watched by
the level: if both are equal, the words of the block repeat at that distance.  Two catches in a row at one distance open a square,
which grows to the left at once and to the right with every later word until a word differs; what it has covered by then is
one run.  A run of four periods always holds three such blocks, so none is lost.

Blocks are compared by names: that of 2**k words is mixed from the names of its halves, so a level costs one operation a word.  What
a catch claims is compared word by word before it counts.  A square inside a run of a shorter period is a multiple of it and is dropped.
Words are appended in batches; a level keeps two blocks of names, and the words stay while their texts are open.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, words

#: Words appended at once.
STEP = 1 << 16
MANY = 4  # a run has this many periods at least
SHORT = 6  # and this many words


class Catchers:
    """Runs of a growing sequence of numbers; `longest` bounds the length of a run."""

    def __init__(self, longest: int, many: int = MANY, short: int = SHORT) -> None:
        if many < 4:
            raise ValueError("a run needs four periods for its squares to be caught")
        self.many, self.short = many, short
        self.codes = np.zeros(0, np.uint64)
        self.size = 0
        self.levels = max(1, (longest // many).bit_length())
        self.names = [np.zeros(0, np.uint64)] * self.levels  # of the last 2 * block suffixes
        self.match = [np.zeros(0, bool)] * self.levels
        self.open: list[list[list[int]]] = [[] for _ in range(self.levels)]  # [first word, period, words so far equal to the one a period on]
        self.done: list[list[tuple[int, int, int]]] = [[] for _ in range(self.levels)]

    def _hold(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.codes):
            grown = np.zeros(max(2 * len(self.codes), self.size + len(new)), np.uint64)
            grown[: self.size] = self.codes[: self.size]
            self.codes = grown
        self.codes[self.size : self.size + len(new)] = new

    def append(self, new: np.ndarray) -> None:
        """Append words and report what they complete."""
        self._hold(new)
        t0, t1 = self.size, self.size + len(new)
        self.size = t1
        for k in range(self.levels):
            self.open[k] = [r for r in self.open[k] if self._grow(k, r)]
        inner = self._known(0)
        below = below_old = None  # names of the level before, and how many of them are old
        at = np.arange(t0, t1)
        for k in range(self.levels):
            block = 1 << k
            old = self.names[k]
            if k == 0:
                fresh = common.mix(new * common.BASE + np.uint64(0x7F4A7C15))
            else:
                half = block >> 1
                fresh = np.zeros(len(new), np.uint64)
                skip = max(0, block - 1 - t0)  # words before the first whole block
                if skip < len(new):
                    right = below[below_old + skip :]
                    left = below[below_old + skip - half : len(below) - half]
                    fresh[skip:] = common.mix(left * common.BASE + right)
            names = np.concatenate([old, fresh])
            match = np.zeros(len(new), bool)
            skip = max(0, 2 * block - 1 - t0)
            if skip < len(new):
                t = at[skip:]
                partner = (t - 2 * block + 1 >> k << k) + block - 1  # last word of the catcher
                match[skip:] = names[partner - (t0 - len(old))] == fresh[skip:]
            before = np.concatenate([np.zeros(max(0, 2 * block - len(self.match[k])), bool), self.match[k], match])
            caught = np.flatnonzero(match & before[block : block + len(new)] & ~before[: len(new)])
            self.names[k], self.match[k] = names[-2 * block :], before[-2 * block :]
            below, below_old = names, len(old)
            if len(caught):
                t = at[caught]
                second = t - 2 * block + 1 >> k << k
                self._catch(k, second - block, t - block + 1 - second, inner)
            if self.open[k] or self.done[k]:
                inner = self._known(k + 1)

    def _known(self, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, furthest end of those) of the runs of the lower levels, as far as they go now."""
        found = [(a, a + n + q) for k in range(upto) for a, q, n in self.open[k]] + [(a, a + n) for k in range(upto) for a, n, _ in self.done[k]]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], np.maximum.accumulate(pairs[:, 1])

    def _catch(self, k: int, first: np.ndarray, period: np.ndarray, inner: tuple[np.ndarray, np.ndarray]) -> None:
        """Open the squares whose blocks begin at `first`, but for those inside a run of a shorter period."""
        starts, ends = inner
        if len(starts):
            i = np.searchsorted(starts, first, side="right") - 1
            out = (i < 0) | (ends[np.maximum(i, 0)] < first + period + (2 << k))
            first, period = first[out], period[out]
        for x, q in zip(first.tolist(), period.tolist()):
            sure = x + (2 << k)
            if not np.array_equal(self.codes[x:sure], self.codes[x + q : sure + q]):
                continue  # equal names of different words
            lo = max(0, x - (1 << k))
            differ = np.flatnonzero(self.codes[lo:x] != self.codes[lo + q : x + q])
            start = lo + int(differ[-1]) + 1 if len(differ) else lo
            run = [start, q, sure - start]
            if self._grow(k, run):
                self.open[k].append(run)

    def _grow(self, k: int, run: list[int]) -> bool:
        """Compare on to the right; False once a word differs, after filing what has become of the run."""
        start, q, n = run
        step = 64
        while start + n + q < self.size:
            a = start + n
            b = min(a + step, self.size - q)
            differ = np.flatnonzero(self.codes[a:b] != self.codes[a + q : b + q])
            if len(differ):
                run[2] = n + int(differ[0])
                self._file(k, run)
                return False
            n = run[2] = b - start
            step *= 4
        return True

    def _file(self, k: int, run: list[int]) -> None:
        start, q, n = run
        if n + q >= max(self.short, self.many * q):
            self.done[k].append((start, n + q, q))

    def finish(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period."""
        for k, runs in enumerate(self.open):
            for run in runs:
                self._file(k, run)
        self.open = [[] for _ in range(self.levels)]
        return sorted((r for d in self.done for r in d), key=lambda r: (r[0], r[2]))


def runs_of(codes: list[np.ndarray], many: int = MANY, short: int = SHORT) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several word sequences, none across two of them.

    Sequences of about one length follow one another in a stream, each behind a word of its own.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in codes]
    classes: dict[int, list[int]] = {}
    for i, c in enumerate(codes):
        if len(c) >= short:
            classes.setdefault(len(c).bit_length() // 2, []).append(i)
    for members in classes.values():
        size = np.array([len(codes[i]) for i in members])
        begin = np.cumsum(size + 1) - size
        taken = np.unique(np.concatenate([codes[i] for i in members]))
        marks = np.setdiff1d(common.mix(np.arange(len(members) + len(taken), dtype=np.uint64)), taken)[: len(members)]
        stream = Catchers(int(size.max()), many, short)
        held: list[np.ndarray] = []
        room = 0
        for i, mark in zip(members, marks):
            held += [np.array([mark], np.uint64), codes[i]]
            room += len(codes[i]) + 1
            if room >= STEP:
                room = _feed(stream, held)
        if held:
            _feed(stream, held)
        found = stream.finish()
        owner = np.searchsorted(begin, [r[0] for r in found], side="right") - 1
        for o, (start, length, period) in zip(owner.tolist(), found):
            out[members[o]].append((start - int(begin[o]), length, period))
    return out


def _feed(stream: Catchers, held: list[np.ndarray]) -> int:
    new = np.concatenate(held)
    held.clear()
    for lo in range(0, len(new), STEP):
        stream.append(new[lo : lo + STEP])
    return 0


RUNS = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def periodic_runs(docs: DataFrame, *, many: int = MANY, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text (see RUNS), and its words without the repetitions.

    A run is a stretch of words with smallest period q, at least `many` * q and `short` words long, that no neighbouring word extends.
    start, length and period are those of the run of greatest length / period, compared exactly; of equal ones that with the smallest start,
    then period.  `collapsed` joins the words by one space, without those that lie in a run after its first period.  A text that is
    null or has no words has no runs and an empty `collapsed`; null ids stay null, and repeated rows are treated alike.
    """

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in common.chunks(texts):
                w = words.split([t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
                found = runs_of([w.hashes[a:z] for a, z in zip(w.first.tolist(), w.last.tolist())], many, short)
                keep = np.ones(len(w.starts), bool)
                best = []
                for first, runs in zip(w.first.tolist(), found):
                    for start, length, period in runs:
                        keep[first + start + period : first + start + length] = False
                    best.append(_best(runs))
                spans = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.array(w.counts), pa.array([len(r) for r in found], pa.int64())]
                cols += [pa.array(c, pa.int64()) for c in zip(*best)]
                cols += [pa.array(spans, kind), pa.array(w.kept(keep), pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in RUNS.split(", ")])

    return common.keyed_texts(docs, id_col, text_col).mapInArrow(run, RUNS)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int | None, ...]:
    best = None
    for start, length, period in runs:  # by start, then period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])


def looped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` where about every tenth text repeats a part of itself up to its end, as its id says.

    With h = crc32 of the decimal id, g = h // 10 and n words: where h % 10 is 0 and n > 0, word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) // (3 + g % 8).  Such texts are joined by one space; all others, and rows without an id, stay.
    """

    @F.pandas_udf("string")
    def loop(key: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([_loop(k, t) for k, t in zip(key, text)], dtype=object)

    key = F.col(id_col).cast("long").cast("string")
    chosen = F.crc32(key) % 10 == 0
    # a function in Python sees every row of a batch, so the others send it null
    return docs.withColumn(text_col, F.when(chosen, loop(key, F.when(chosen, F.col(text_col)))).otherwise(F.col(text_col)))


def _loop(key: str, text: str | None) -> str | None:
    if text is None:
        return None
    w = words.split([text.encode("utf-8", "surrogatepass")])
    n = len(w.starts)
    if not n:
        return text
    g = zlib.crc32(key.encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    raw = w.codes.tobytes()
    part = [raw[s:e] for s, e in zip(w.starts[: a + p].tolist(), w.ends[: a + p].tolist())]
    return b" ".join([part[i] for i in order.tolist()]).decode("utf-8", "surrogatepass")
