"""Toxicity by a factorization machine over hashed terms.

A document with n words has the terms of its words in lower case: the word, its opening four and five bytes, and every five
bytes inside; term i with c occurrences has the value x_i = sqrt(c / n).  The log-odds are

    w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so that two terms together (an insult and the mention of a group) can weigh more than their sum.  Weights are learned by
gradient steps on a bounded sample of labelled rows.  Shrinking leaves most linear weights at zero, but a term without one
keeps its factors, for it may count in pairs alone.  Only terms with a weight or factors are broadcast; scoring is narrow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common, labelled

TERM_BITS = 22
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _term(x: np.ndarray) -> np.ndarray:
    return (common.mix(x) >> np.uint64(64 - TERM_BITS)).astype(np.int32)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, term) of every term, and the words of each text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b" " + b" ".join([*raw, b""]), np.uint8)
    ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    blank = ~_LETTER[codes]
    codes = np.where(blank, 32, codes).astype(np.uint32)
    edge = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    doc_of = np.searchsorted(ends_of, np.arange(len(codes)), side="left").astype(np.int32)
    word_doc = doc_of[starts]
    docs = [word_doc]
    found = [_term(common.slice_hash(common.prefix_hash(codes), starts, ends))]
    for n in (5, 6):  # with the blank at an edge; six only from the opening blank
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        out = np.zeros(m, bool) if n == 5 else ~blank[:m]
        packed = np.full(m, n, np.uint64)
        for j in range(n):
            packed = (packed << np.uint64(8)) | codes[j : j + m]
            if 0 < j < n - 1 or (n == 6 and j == n - 1):
                out |= blank[j : j + m]
        at = np.flatnonzero(~out)
        docs.append(doc_of[at + 1])
        found.append(_term(packed[at]))
    return np.concatenate(docs), np.concatenate(found), np.bincount(word_doc, minlength=len(texts))


@dataclass
class Model:
    """Weights of the terms that have one; `linear` and `factors` by the order of `ids`."""

    bias: float
    ids: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def place(self) -> np.ndarray:
        """Row of each term, -1 for terms without weights; made once per worker."""
        table = self.__dict__.get("_place")
        if table is None:
            table = np.full(1 << TERM_BITS, -1, np.int32)
            table[self.ids] = np.arange(len(self.ids))
            self.__dict__["_place"] = table
        return table

    def log_odds(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, hi in common.chunks(texts):
            doc, term, words = terms(texts[lo:hi])
            row = self.place()[term]
            seen = row >= 0
            key, count = np.unique(doc[seen].astype(np.int64) << 32 | row[seen], return_counts=True)
            doc, row = key >> 32, key & 0xFFFFFFFF
            x = np.sqrt(count / np.maximum(1, words[doc]))
            out[lo:hi] += self._evidence(doc, row, x, hi - lo)
        return out

    def odds_of(self, docs: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
        """Log-odds of documents that are given as distinct terms and their values."""
        term, x = np.concatenate(docs), np.concatenate(values).astype(float)
        doc, row = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), self.place()[term]
        seen = row >= 0
        return self.bias + self._evidence(doc[seen], row[seen], x[seen], len(docs))

    def _evidence(self, doc: np.ndarray, row: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        out += np.bincount(doc, self.linear[row] * x, minlength=n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[row, f] * x
            out += (np.bincount(doc, vx, minlength=n) ** 2 - np.bincount(doc, vx * vx, minlength=n)) / 2
        return out


def train(docs: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, *, factors: int = 4, epochs: int = 14, rate: float = 40.0, shrink: float = 3e-4, rare: int = 4, slower: float = 40.0, seed: int = 11) -> Model:
    """Gradient steps over batches of 16 documents; linear weights shrink toward zero at each of their steps.

    Every term of at least `rare` documents has factors from the first epoch, whatever its linear weight.  Rarer terms are
    no evidence.  Steps of factors are `slower` times smaller than those of linear weights.
    """
    rng = np.random.default_rng(seed)
    ids, flat = np.unique(np.concatenate(docs), return_inverse=True)
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    at = np.cumsum(sizes) - sizes
    often = np.bincount(flat) >= rare
    w = np.zeros(len(ids))
    v = np.zeros((len(ids), factors))
    v[often] = rng.normal(0, 0.1, (int(often.sum()), factors))
    w0 = 0.0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), 16):
            some = order[lo : lo + 16]
            n = len(some)
            rows = flat[common.ranges(at[some], sizes[some])]
            x = np.concatenate([values[i] for i in some]).astype(float)
            own = np.repeat(np.arange(n), sizes[some])
            keep = often[rows]
            rows, x, own = rows[keep], x[keep], own[keep]
            z = w0 + np.bincount(own, w[rows] * x, minlength=n)
            vx = v[rows] * x[:, None]
            total = np.stack([np.bincount(own, vx[:, f], minlength=n) for f in range(factors)], axis=1)
            z += ((total**2).sum(axis=1) - np.bincount(own, (vx * vx).sum(axis=1), minlength=n)) / 2
            d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels[some]) / n
            here, inverse = np.unique(rows, return_inverse=True)
            moved = w[here] - step * np.bincount(inverse, d[own] * x, minlength=len(here))
            w[here] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * shrink)
            for f in range(factors):
                gf = np.bincount(inverse, d[own] * x * (total[own, f] - vx[:, f]), minlength=len(here))
                v[here, f] -= np.clip(step / slower * (gf + 1e-4 * v[here, f]), -0.2, 0.2)
            w0 -= step / 30 * d.sum()
    strong = (w != 0) | (v != 0).any(axis=1)
    return Model(float(w0), ids[strong], w[strong], v[strong])


def chosen_step(docs: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, choices: tuple[float, ...], *, parts: int = 2, seed: int = 23) -> float:
    """The `slower` of `choices` with the least log loss on training rows that its models did not see; ties to the larger one.

    The training rows are dealt in `parts`; each part is scored by a model of the others.  Rows outside the training set
    take no part.  Where a model would see one class only, the largest choice is taken.
    """
    part = np.random.default_rng(seed).permutation(len(docs)) % parts
    if any(len(np.unique(labels[part != k])) < 2 for k in range(parts)):
        return max(choices)

    def loss(slower: float) -> float:
        total = 0.0
        for k in range(parts):
            learn, check = np.flatnonzero(part != k), np.flatnonzero(part == k)
            model = train([docs[i] for i in learn], [values[i] for i in learn], labels[learn], slower=slower)
            if len(check):
                odds = model.odds_of([docs[i] for i in check], [values[i] for i in check])
                total += float(np.logaddexp(0, np.where(labels[check] == 1, -odds, odds)).sum())
        return total

    return min(sorted(choices, reverse=True), key=loss)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, fold: int = 2, per_class: int = 1500, slower: tuple[float, ...] = (4.0, 12.0, 40.0), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most `per_class` rows of each label outside the held-out fold; only their terms reach the driver.

    How much `slower` factors step than linear weights is chosen by parts of these training rows alone.

    Odds are those of the sample, in which the classes are even where there are enough rows: toxic rows are rare, and a low
    threshold on such odds finds them without catching clean ones.
    """
    few, counts = labelled.sample(docs, labels, label, folds=folds, fold=fold, per_class=per_class, id_col=id_col, text_col=text_col)

    def run(batches):
        for b in batches:
            found, values = [], []
            for t in b.column("text").to_pylist():
                _, term, words = terms([t])
                ids, n = np.unique(term, return_counts=True)
                found.append(ids)
                values.append(np.sqrt(n / max(1, words[0])).astype(np.float32))
            cols = [b.column("label"), pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "terms", "values"])

    rows = few.mapInArrow(run, "label int, terms array<int>, values array<float>").toArrow()
    y = rows.column("label").to_numpy()
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    full = [i for i, n in enumerate(pa.compute.list_value_length(rows.column("terms")).to_pylist()) if n]
    if len({*y[full].tolist()}) < 2:
        return Model(prior, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, 1)))
    lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("terms", "values")]
    found, values, y = [lists[0][i] for i in full], [lists[1][i] for i in full], y[full].astype(float)
    return train(found, values, y, slower=chosen_step(found, values, y, slower))


def score(docs: DataFrame, model: Model, *, folds: int = 4, fold: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; a text without known terms has the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            odds = shared.value.log_odds(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], ["doc_id", "score"])

    rows = common.keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", labelled.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def odds(text):
        import pandas as pd

        return pd.Series(shared.value.log_odds([t or "" for t in text]))

    return docs.where(1 / (1 + F.exp(-odds(F.col(text_col).cast("string")))) < threshold)
