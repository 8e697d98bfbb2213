"""Quality classifier with supervised subword embeddings.

A document is the mean of the learned vectors of its hashed features: words, the three- and four-byte pieces of words with
their edges, and word pairs in which a word repeats the one before it.  A softmax layer over that mean gives the classes.
Vectors and layer are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows.

The softmax of a mean is the softmax of the mean of (vector times layer), so scoring needs one number per feature; it is
narrow work over whole texts, nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, labelled

BUCKET_BITS = 18
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _bucket(x: np.ndarray) -> np.ndarray:
    return (common.mix(x) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every feature of the texts."""
    codes = np.frombuffer(b" " + b" ".join([*raw, b""]), np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    blank = _BLANK[codes]
    codes = np.where(blank, 32, codes).astype(np.uint32)
    edge = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    word = common.slice_hash(common.prefix_hash(codes), starts, ends)
    doc_of = np.searchsorted(ends_of, np.arange(len(codes)), side="left").astype(np.int32)
    word_doc = doc_of[starts]
    again = np.flatnonzero((word[1:] == word[:-1]) & (word_doc[1:] == word_doc[:-1]))
    docs, found = [word_doc, word_doc[again + 1]], [_bucket(word), np.full(len(again), int(_bucket(np.array([1], np.uint64))[0]), np.int32)]
    for n in (3, 4):
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        inner = np.zeros(m, bool)
        packed = np.full(m, n, np.uint64)
        for j in range(n):
            packed = (packed << np.uint64(8)) | codes[j : j + m]
            if 0 < j < n - 1:
                inner |= blank[j : j + m]
        at = np.flatnonzero(~inner)
        docs.append(doc_of[at + 1])
        found.append(_bucket(packed[at]))
    return np.concatenate(docs), np.concatenate(found)


@dataclass
class Model:
    """One number per bucket and a bias: the log-odds of label 1 are bias + mean of the buckets' numbers."""

    weights: np.ndarray
    bias: float

    def log_odds(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in common.chunks(texts):
            doc, bucket = features([t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
            n = np.bincount(doc, minlength=hi - lo)[: hi - lo]
            total = np.bincount(doc, self.weights[bucket], minlength=hi - lo)[: hi - lo]
            out[lo:hi] = total / np.maximum(1, n)
        return out + self.bias


def train(docs: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, *, size: int = 8, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> np.ndarray:
    """Vector-times-layer difference per bucket after gradient descent over the documents, and the bias last.

    docs: distinct buckets of each document; shares: their part of its features.
    """
    rng = np.random.default_rng(seed)
    used, flat = np.unique(np.concatenate(docs), return_inverse=True)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    at = np.cumsum(sizes) - sizes
    vectors = rng.uniform(-1 / size, 1 / size, (len(used), size)).astype(np.float32)
    layer = np.zeros((size, 2), np.float32)
    bias = np.zeros(2, np.float32)
    batch = 16
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            place = common.ranges(at[some], sizes[some])
            rows = flat[place]
            share = np.concatenate([shares[i] for i in some]).astype(np.float32)
            cuts = np.cumsum(sizes[some]) - sizes[some]
            mean = np.add.reduceat(vectors[rows] * share[:, None], cuts, axis=0)
            raw = mean @ layer + bias
            p = np.exp(raw - raw.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), labels[some]] -= 1
            back = np.repeat(p @ layer.T, sizes[some], axis=0) * share[:, None]
            layer -= step / len(some) * (mean.T @ p)
            bias -= step / len(some) * p.sum(axis=0)
            here, inverse = np.unique(rows, return_inverse=True)
            for d in range(size):
                vectors[here, d] -= step * np.bincount(inverse, back[:, d]).astype(np.float32)
    out = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    out[used] = vectors @ (layer[:, 1] - layer[:, 0])
    out[-1] = bias[1] - bias[0]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 3, fold: int = 1, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `per_class` rows of each label outside the held-out fold; only their features reach the driver."""
    few, counts = labelled.sample(docs, labels, label, folds=folds, fold=fold, per_class=per_class, id_col=id_col, text_col=text_col)

    def run(batches):
        for b in batches:
            buckets, shares = [], []
            for t in b.column("text").to_pylist():
                found, n = np.unique(features([t.encode("utf-8", "surrogatepass")])[1], return_counts=True)
                buckets.append(found)
                shares.append((n / max(1, n.sum())).astype(np.float32))
            cols = [b.column("label"), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "buckets", "shares"])

    rows = few.mapInArrow(run, "label int, buckets array<int>, shares array<float>").toArrow()
    y = rows.column("label").to_numpy()
    prior = np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    weights = np.zeros((1 << BUCKET_BITS) + 1, np.float32)
    full = [i for i, n in enumerate(pa.compute.list_value_length(rows.column("buckets")).to_pylist()) if n]
    if len({*y[full].tolist()}) < 2:
        return Model(weights[:-1], float(prior))
    lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("buckets", "shares")]
    weights = train([lists[0][i] for i in full], [lists[1][i] for i in full], y[full])
    taken = np.log((y == 1).sum() / (y == 0).sum())
    return Model(weights[:-1], float(weights[-1] + prior - taken))


def score(docs: DataFrame, model: Model, *, folds: int = 3, fold: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; an empty or null text has the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            odds = shared.value.log_odds(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], ["doc_id", "score"])

    rows = common.keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", labelled.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
