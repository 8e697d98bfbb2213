"""Document fingerprints by winnowing.

Every k consecutive code points have a rolling hash; of every `window` consecutive hashes the smallest is chosen, the
rightmost of equal ones, and kept with its position.  Two texts that share `window + k - 1` code points in a row share a
fingerprint, wherever the passage stands.  A text with fewer hashes than a window has their minimum; one shorter than k has
the hash of the whole text at position 0; an empty text has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

K, WINDOW = 16, 32


def window_minima(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, index) of the minimum of every `window` consecutive values, the rightmost of equal ones."""
    value, index = values, np.arange(len(values), dtype=np.int32)
    width = 1
    while width < window:
        step = min(width, window - width)
        right, right_at = value[step:], index[step:]
        value, index = value[: len(right)], index[: len(right)]
        take = right <= value
        index = np.where(take, right_at, index)
        value = np.minimum(right, value)
        width += step
    return value, index


def choose(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int, window: int):
    """Chosen (text index, hash, position in the text) of texts that stand at `starts` in `codes`."""
    texts = np.arange(len(starts))
    prefix = common.prefix_hash(codes)
    n_grams = lengths - k + 1
    out = []
    if len(codes) >= k:
        at = np.arange(len(codes) - k + 1)
        grams = common.slice_hash(prefix, at, at + k)
        full = n_grams >= window
        if full.any():
            _, index = window_minima(grams, window)
            begin = common.ranges(starts[full], n_grams[full] - window + 1)
            owner = np.repeat(texts[full], n_grams[full] - window + 1)
            chosen = index[begin].astype(np.int64)
            new = np.ones(len(chosen), bool)
            new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
            out.append((owner[new], grams[chosen[new]], chosen[new] - starts[owner[new]]))
        few = np.flatnonzero((n_grams > 0) & (n_grams < window))
        if len(few):
            best = [int(s + n - 1 - np.argmin(grams[s : s + n][::-1])) for s, n in zip(starts[few], n_grams[few])]
            best = np.array(best)
            out.append((few, grams[best], best - starts[few]))
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        out.append((short, common.slice_hash(prefix, starts[short], starts[short] + lengths[short]), np.zeros(len(short), np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, grams, place = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(owner, kind="stable")
    return owner[order], grams[order], place[order]


def fingerprints_of(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, in the order of positions."""
    out: list = []
    for lo, hi in common.chunks(texts):
        codes = common.code_points("".join(texts[lo:hi]))
        lengths = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
        owner, grams, place = choose(codes, np.cumsum(lengths) - lengths, lengths, k, window)
        cuts = np.searchsorted(owner, np.arange(1, hi - lo))
        out.extend(zip(np.split(grams, cuts), np.split(place, cuts)))
    return out


def digest(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Short name of a fingerprint: equal for equal hashes at equal positions."""
    h = hashlib.blake2b(fingerprint[0].astype("<u8").tobytes(), digest_size=16)
    h.update(fingerprint[1].astype("<u4").tobytes())
    return h.hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (sorted, distinct): 1 for equal ones, two empty ones included."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def fingerprints(docs: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, positions) of every whole text.  Narrow: nothing is shuffled.

    Null and empty texts have empty arrays; null ids stay null; repeated rows give repeated rows.
    """

    def run(batches):
        for b in batches:
            found = fingerprints_of(b.column("text").to_pylist(), k, window)
            cols = [[f[0].view(np.int64) for f in found], [f[1].astype(np.int32) for f in found]]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols, kinds)], ["doc_id", "hashes", "positions"])

    return common.keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, hashes array<long>, positions array<int>")


def with_neighbours(docs: DataFrame, *, block_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, extra, key, doc_id, text) dealt so that each document's successor by descending id stands in its block.

    Blocks are ranges of ids between quantiles, which are themselves ids; the first document of a block is copied to
    the end of the block above it, the very first document to the end of the last block.  Only the quantiles reach the
    driver, one per `block_docs` documents, and go to the tasks as a broadcast of 8 bytes each; each text is shuffled once, and
    each block has a task of its own.  Null ids come last.
    """
    rows = common.keyed_texts(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    keys = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"))
    n_blocks = common.blocks_for(keys.count(), block_docs)
    at = [(i + 1) / n_blocks for i in range(n_blocks)]
    found = keys.agg(F.percentile_approx("key", F.array(*map(F.lit, at)), max(1000, 20 * n_blocks)).alias("q"), F.max("key").alias("top")).first()
    shared = docs.sparkSession.sparkContext.broadcast(np.unique(np.array([*(found["q"] or []), *([] if found["top"] is None else [found["top"]])], np.int64)))

    @F.pandas_udf("array<struct<block:int,extra:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        ids, bounds = key.to_numpy(np.int64), shared.value
        block = np.searchsorted(bounds, ids, side="left")
        first = bounds[np.minimum(block, len(bounds) - 1)] == ids
        above = np.where(block + 1 < len(bounds), block + 1, 0)
        return pd.Series([[(b, False), (a, True)] if f else [(b, False)] for b, f, a in zip(block.tolist(), first.tolist(), above.tolist())])

    dealt = rows.withColumn("place", F.explode(places("key"))).select("place.block", "place.extra", "key", "doc_id", "text")
    return dealt.repartitionById(n_blocks, "block").sortWithinPartitions("block", "extra", F.desc("key"), "text")


def compare_with_edits(docs: DataFrame, *, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, with their likeness.

    The edit replaces the last half of the code points (rounded down) by the first as many of the next document, by
    descending id; the last document is followed by the first, a lone document by itself.  Rows with equal ids follow one
    another by text.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_fingerprints.  Likeness is the Jaccard measure of the sets of hashes.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_fingerprints int"

    def finish(rows: list) -> pa.RecordBatch:
        """Rows but the last, each followed by its successor; rows: [doc_id, block, extra, text]."""
        texts = [r[3] for r in rows]
        found = fingerprints_of(texts, k, window)
        sets = [np.unique(f[0]) for f in found]
        pairs = [i for i in range(len(rows) - 1) if not rows[i][2] and rows[i][1] == rows[i + 1][1]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in pairs]
        other = fingerprints_of(edited, k, window)
        out = [
            (
                rows[i][0], len(texts[i]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), digest(found[i]), digest(o),
                likeness(sets[i], np.unique(o[0])), likeness(sets[i], sets[i + 1]), len(found[i][0]),
            )
            for i, e, o in zip(pairs, edited, other)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
        cols = list(zip(*out)) or [()] * len(kinds)
        names = [c.split()[0] for c in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    def run(batches):
        held: list = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "block", "extra", "text"))):
                held.append(row)
                size += len(row[3])
                if size > common.CHUNK_CHARS:
                    yield finish(held)
                    held, size = held[-1:], len(row[3])
        if held:
            yield finish(held)

    return with_neighbours(docs, id_col=id_col, text_col=text_col).mapInArrow(run, schema)
