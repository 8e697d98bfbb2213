"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of unit vectors; every row then goes to a leaf.  A query walks the tree best bin first:
a priority queue holds the branches seen so far by the distance of their centres, the nearest is opened next, and leaves are
visited in the order in which they come up.  How many leaves a query visits is calibrated: for a few queries the exact
neighbours are found against all rows, and the visits are widened until the wanted recall is reached.

Equal vectors are one entry with its `k + 1` smallest ids, which is all that any answer can show of them.  Rows of a leaf and
the queries that visit it are dealt in blocks of bounded size, so no leaf is one task's burden.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common


@dataclass
class Tree:
    """Nodes with their centres; children of inner nodes, leaf numbers of the others."""

    centres: list[np.ndarray] = field(default_factory=list)  # of the children of each inner node
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def _node(self) -> int:
        self.centres.append(np.zeros((0, 0)))
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    @classmethod
    def fit(cls, vectors: np.ndarray, *, branches: int = 8, leaf_size: int = 40, turns: int = 8, seed: int = 5) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)
        todo = [(tree._node(), np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            part = vectors[rows]
            own = np.zeros(len(rows), np.int64)
            if len(rows) > leaf_size:
                centres = np.unique(part[rng.choice(len(rows), branches, replace=False)], axis=0)
                for _ in range(turns):
                    own = np.argmax(part @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
                    live = np.unique(own)
                    centres = np.stack([part[own == c].mean(axis=0) for c in live])
                    own = np.searchsorted(live, own)
                own = np.argmax(part @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            if len(np.unique(own)) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
                continue
            tree.centres[node] = centres
            for c in range(len(centres)):
                child = tree._node()
                tree.children[node].append(child)
                todo.append((child, rows[own == c]))
        return tree

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            centres = self.centres[node]
            own = np.argmax(vectors[rows] @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
            todo.extend((child, rows[own == c]) for c, child in enumerate(self.children[node]))
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves in best-bin-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            away = ((self.centres[node] - query) ** 2).sum(axis=1)
            for d, child in zip(away.tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))
        return out


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision, the same for equal rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query index, id, score) of the k nearest of each query, ties to smaller ids."""
    near = units(queries) @ units(vectors).T
    kept = min(k, len(ids))
    bound = np.partition(near, len(ids) - kept, axis=1)[:, len(ids) - kept] - 1e-9
    q, v = np.nonzero(near >= bound[:, None])
    score = cosines(queries[q], vectors[v])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], ids[v[keep]], score[keep]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """((vec_id, vector) of the rows that take part, their dimension): no nulls, no zero vectors, all components finite.

    Vectors of another dimension than the most frequent one take no part either.
    """
    v = F.col("vector")
    fine = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    )
    sizes = fine.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0
    return fine.where(F.size("vector") == size), size


def _few(rows: DataFrame, most: int, salt: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("vec_id", F.lit(salt)), "vec_id").limit(most)


def search(
    rows: DataFrame, is_query, k: int = 5, *, recall: float = 0.97, sample: int = 20_000, calibration: int = 200, leaf_size: int | None = None, block: int = 4096,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every row for which `is_query` (a condition on vec_id) holds.

    Candidates are all other rows; nearness is the cosine in double precision on the vectors as given.  `sample` bounds the
    vectors that the tree is fitted on, `calibration` the queries whose exact neighbours set the number of visits: the least
    for which `recall` of their neighbours lie in visited leaves.  Leaves hold a 128th of the sampled vectors at most (40 where
    they are few), so the number of leaves, and with it the visits of a query, stays bounded however many rows there are.
    Repeated ids are repeated candidates.
    """
    fine, size = usable(rows, id_col, vector_col)
    if not size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    entries = common.written(fine.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1).drop("n"))
    fitted = np.array([r["vector"] for r in _few(entries, sample, 1).collect()])
    tree = Tree.fit(units(fitted), leaf_size=leaf_size or max(40, len(fitted) // 128))
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.leaf_of(units(matrix(b.column("vector"), size)))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(leaf)], ["vec_id", "vector", "leaf"])

    placed = common.written(entries.mapInArrow(place, "vec_id long, vector array<double>, leaf int"))
    queries = fine.where(is_query)
    visits = _calibrated(placed, _few(queries, calibration, 2), tree, k, recall, size)

    # one question per distinct vector; every query row of that vector reads its answer
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("question"))
    asked = common.written(asked)

    def walk(batches):
        for b in batches:
            if b.num_rows:
                order = [shared.value.best_bins(v, visits) for v in units(matrix(b.column("vector"), size))]
                yield pa.RecordBatch.from_arrays([b.column("question"), b.column("vector"), pa.array(order, pa.list_(pa.int32()))], ["question", "vector", "leaves"])

    visited = asked.select("question", "vector").mapInArrow(walk, "question long, vector array<double>, leaves array<int>")
    visited = common.written(visited.select("question", "vector", F.explode("leaves").alias("leaf")))
    # blocks: one row per leaf, and the tree bounds the leaves
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("rows"))
    turns = visited.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("questions"))
    plan = F.broadcast(common.written(parts.join(turns, "leaf")))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visited.join(plan, "leaf").select(
        "leaf", "question", "vector", F.pmod(F.xxhash64("question"), F.col("questions")).cast("int").alias("qb"), spread("rows").alias("rb")
    )
    right = placed.join(plan, "leaf").select(
        "leaf", "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.col("rows")).cast("int").alias("rb"), spread("questions").alias("qb")
    )
    schema = "question long, vec_id long, score double"

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["question", "vec_id", "score"]
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        asked, ids = q.column("question").to_numpy(), c.column("vec_id").to_numpy()
        at, near, score = nearest(matrix(q.column("vector").combine_chunks(), size), matrix(c.column("vector").combine_chunks(), size), ids, k + 1)
        return pa.table([pa.array(x) for x in (asked[at], near, score)], names)

    keys = ["leaf", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
    best = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    answers = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    mine = queries.join(asked, "vector").select(F.col("vec_id").alias("query_id"), "question")
    full = mine.join(answers, "question").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return full.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _calibrated(placed: DataFrame, few: DataFrame, tree: Tree, k: int, recall: float, size: int) -> int:
    """The least number of visits that finds `recall` of the exact neighbours of a few queries."""
    few = few.collect()
    if not few:
        return 1
    ids, vectors = np.array([r["vec_id"] for r in few]), np.array([r["vector"] for r in few], float)

    def exact(batches):
        for b in batches:
            if b.num_rows:
                own = b.column("vec_id").to_numpy()
                at, near, score = nearest(vectors, matrix(b.column("vector"), size), own, k + 1)
                leaf = pd.Series(b.column("leaf").to_numpy(), own)
                leaf = leaf[~leaf.index.duplicated()]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(near), pa.array(score), pa.array(leaf[near].to_numpy(np.int32))], ["at", "vec_id", "score", "leaf"])

    best = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    near = placed.mapInArrow(exact, "at long, vec_id long, score double, leaf int").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    place = [{leaf: i for i, leaf in enumerate(tree.best_bins(v, tree.leaves))} for v in units(vectors)]
    needed = sorted(place[r["at"]][r["leaf"]] + 1 for r in near.collect() if r["vec_id"] != ids[r["at"]])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if needed else 1
