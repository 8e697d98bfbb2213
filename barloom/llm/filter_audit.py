"""How a chain of filters shares its removals: counts of every order, and exact Shapley values.

What a chain removes depends only on which filters each document fails, so documents are summed to one row per part and set of
failed filters before anything else.  With v(S) the documents of a part that fail a filter of S, all 2**m values of v are
tabulated; the step that applies j after the filters S removes v(S + j) - v(S).

The Shapley values are the weights of the additive model that fits v best: least squares over all coalitions S with the weight
(m - 1) / (C(m, |S|) |S| (m - |S|)), bound to sum to v of all filters.  The normal equations, bordered by that bound, are solved in
rationals, so the values are exact; times m! they are whole numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.words import PATTERN

#: Rows without an id are dealt by this many salts, for they all share the null key.
SALTS = 64


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def solve(rows: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """x with rows @ x = right, by elimination in rationals; the system is regular."""
    m = [[*map(Fraction, r), Fraction(b)] for r, b in zip(rows, right)]
    for i in range(len(m)):
        pivot = next(k for k in range(i, len(m)) if m[k][i])
        m[i], m[pivot] = m[pivot], m[i]
        m[i] = [x / m[i][i] for x in m[i]]
        for k in range(len(m)):
            if k != i and m[k][i]:
                m[k] = [x - m[k][i] * y for x, y in zip(m[k], m[i])]
    return [r[-1] for r in m]


def shapley(value: list[int]) -> list[Fraction]:
    """Shapley values of a game with value[S] for every coalition S, a bit set; value[0] is 0."""
    players = len(value).bit_length() - 1
    if players == 1:
        return [Fraction(value[1])]
    coalitions = range(1, len(value) - 1)
    weight = {s: Fraction(players - 1, comb(players, k := s.bit_count()) * k * (players - k)) for s in coalitions}
    has = lambda s, i: s >> i & 1
    normal = [[sum(w for s, w in weight.items() if has(s, i) and has(s, j)) for j in range(players)] + [1] for i in range(players)]
    right = [sum(w * value[s] for s, w in weight.items() if has(s, i)) for i in range(players)]
    return solve([*normal, [1] * players + [0]], [*right, value[-1]])[:players]


def per_part(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], *, part_col: str, id_col: str, text_col: str) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the set of filters they fail; the bit after `filters` marks copies.

    Only ids, masks and digests of texts are shuffled.  Copies are counted through sums per text and part, so that a text with
    very many copies is one row per task before it is dealt out.
    """
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(filters.values())]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        sum(bits, F.lit(0)).alias("mask"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("digest"),
    )
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest", "part"), F.lit(SALTS))).otherwise(0))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("doc_id", "good", "toxic")
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("salt", F.lit(0))
    kind = ["digest", "part", "mask", "good", "toxic"]
    marked = rows.join(marks, ["doc_id", "salt"], "left").fillna(False, ["good", "toxic"])
    alike = marked.groupBy("doc_id", "salt", *kind).agg(F.count("*").alias("n"))

    known = F.when(F.col("doc_id").isNotNull(), F.col("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = alike.groupBy(*kind).agg(F.sum("n").alias("n"), F.coalesce(F.sum(known), F.lit(0)).alias("known"), least.alias("least"))
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    texts = texts.join(first, "digest")
    originals = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    texts = texts.withColumn("copies", F.col("known") - F.when(F.col("known") > 0, originals).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + (1 << len(filters))).alias("mask"), F.col("copies").alias("n"))))
    split = texts.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.*")
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}")
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))


def chains(m: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All orders of m filters, the filter of every step and the set of those before it."""
    orders = list(permutations(range(m)))
    at = np.array(orders)
    bit = 1 << at
    return orders, at, np.cumsum(bit, axis=1) - bit


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, *, filters: dict[str, Column] | None = None, copies: str = "E", part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step (see STEPS).

    `filters` gives each letter its failure condition; `copies` names the last filter, which a document fails if a smaller id has
    the same text anywhere in the table.  A row without an id is no copy and no original, rows of one id and one text are
    not copies of one another, and an id with several label rows has each mark that one of them has.  A null part counts as the empty
    one, a null condition as passed; an empty table gives no rows.  `shapley` is the sum of the filter's removals over all orders.
    """
    filters = text_filters(F.col(text_col)) if filters is None else filters
    names = [*filters, copies]
    m = len(names)
    counts = per_part(docs, labels, filters, part_col=part_col, id_col=id_col, text_col=text_col)
    table = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 2**m at most
    orders, at, before = chains(m)
    label = ["".join(names[i] for i in o) for o in orders]

    def run(batches):
        sets = np.arange(1 << m)
        meets = (sets[:, None] & sets[None, :]) != 0  # coalition x failed set
        for pdf in batches:
            for part, cells in zip(pdf["part"], pdf["cells"]):
                held = np.zeros((3, 1 << m), np.int64)
                for c in cells:
                    held[:, c["mask"]] = c["n"], c["n_good"], c["n_toxic"]
                value, good, toxic = held @ meets.T
                fair = [x * factorial(m) for x in shapley(value.tolist())]
                if any(x.denominator != 1 for x in fair):
                    raise ArithmeticError(f"shares that are no whole numbers: {fair}")
                after = before | 1 << at
                removed = value[after] - value[before]
                fails = np.array([held[0][(sets >> i & 1) == 1].sum() for i in range(m)])
                whole = held[0].sum()
                yield pd.DataFrame(
                    {
                        "part": part, "filter_order": np.repeat(label, m), "step": np.tile(np.arange(1, m + 1), len(label)),
                        "kept": (whole - value[after]).ravel(), "removed": removed.ravel(), "redundant": (fails[at] - removed).ravel(),
                        "unique_fails": held[0][1 << at].ravel(), "good_lost": (good[after] - good[before]).ravel(),
                        "toxic_lost": (toxic[after] - toxic[before]).ravel(), "shapley": np.array([int(x) for x in fair])[at].ravel(),
                    }
                )

    return table.mapInPandas(run, STEPS)


#: The audit with the filters A to E over `documents` and `labels`.
TWIN = r"""
WITH marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(min(texts.doc_id) OVER (PARTITION BY text) < texts.doc_id, false)} AS f
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id
), sets AS (
  SELECT part, [k FOR k IN ['A', 'B', 'C', 'D', 'E'] IF f[k]] AS failed, count(*) AS n,
         count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM (SELECT part, good, toxic, map {'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E} AS f FROM fails) GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, unnest(range(1, 6)) AS step FROM orders
), counted AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS letter,
    sum(n) FILTER (NOT list_has_any(failed, o[:step])) AS kept,
    sum(n) FILTER (list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])) AS removed,
    sum(n) FILTER (list_contains(failed, o[step]) AND list_has_any(failed, o[:step - 1])) AS redundant,
    sum(n) FILTER (failed = [o[step]]) AS unique_fails,
    sum(n_good) FILTER (list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])) AS good_lost,
    sum(n_toxic) FILTER (list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1])) AS toxic_lost
  FROM sets, steps GROUP BY part, o, step
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
