"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of (source, language, topic).  Raking multiplies the keep rate of every cell, one margin after the
other, until the kept tokens of each source, language and topic are the wanted shares of the kept total; a rate never
exceeds 1, and what a full cell cannot give is raised from the others in the next turn.  Documents are then sampled with the
rate of their cell by a hash of their id, so the choice is the same under any partitioning.

A language or topic without a target of its own counts as OTHER, and so does a source where the caller names the source targets.
With `temper` every source has a target and is raked: its share of the tokens, raised to that power.  The cells of many sources
stay a DataFrame (`_swept`); at most DRIVER_CELLS of them are raked by the driver, with the same results.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common

OTHER = "(other)"
MARGINS = ("source", "lang", "topic")
#: Cells up to this number are raked in the memory of the driver.
DRIVER_CELLS = 100_000
#: Rounds of raking, the change of a rate that ends them, and the rounds after which `_swept` writes its rates.
ROUNDS, CLOSE, WRITE_EVERY = 500, 1e-9, 16


def topic_of(text: Column) -> Column:
    """A coarse topic from whole texts: licence notes, tables, secrets and code, or prose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("license") | low.contains("copyright"), "legal")
        .when(low.contains(" | "), "table")
        .when(low.contains(" = \"") | low.contains("://"), "code")
        .otherwise("prose")
    )


def tempered(shares: Mapping[str, float], power: float) -> dict[str, float]:
    """Shares raised to a power below 1, so that large values give to small ones; they sum to 1."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(mass: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray], keep: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Keep rate of each cell with its mass; groups: the number of the cell's value in each margin; targets: shares by number.

    Shares are taken among the values that have mass.  Without mass every rate is `keep`.
    """
    rate = np.full(len(mass), float(keep))
    wanted = []
    for group, target in zip(groups, targets):
        there = np.bincount(group, mass, minlength=len(target)) > 0
        share = np.where(there, target, 0.0)
        wanted.append(keep * mass.sum() * share / share.sum() if share.sum() else share)
    for _ in range(rounds):
        before = rate
        for group, want in zip(groups, wanted):
            now = np.bincount(group, rate * mass, minlength=len(want))
            rate = np.minimum(1.0, rate * np.divide(want, now, out=np.ones_like(want), where=now > 0)[group])
        if np.abs(rate - before).max(initial=0) < close:
            break
    return rate


def cells(docs: DataFrame, columns: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Tokens and documents per cell of known values."""
    return docs.select(*_values(columns, targets), tokens.cast("double").alias("n")).groupBy(*MARGINS).agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))


def _values(columns: Mapping[str, Column], targets: Mapping[str, Mapping[str, float]]) -> list[Column]:
    """The value of each margin; a margin that `targets` does not name keeps all its values."""
    known = {m: columns[m].isin(*targets[m]) if m in targets else columns[m].isNotNull() for m in MARGINS}
    return [F.when(known[m], columns[m]).otherwise(OTHER).alias(m) for m in MARGINS]


def _wanted(targets: Mapping[str, float], rest: float) -> np.ndarray:
    """Shares of the values with a target and, last, of OTHER, whose own share `rest` is its target."""
    total = sum(targets.values()) or 1.0
    return np.array([*((1 - rest) * v / total for v in targets.values()), rest])


def rates(docs: DataFrame, columns: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float]], *, keep: float, temper: float | None = None, most: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, documents, rate) of every cell.  A value without a target has its own share as target.

    With `temper`, each source that is not null has its token share raised to this power as target, however many there are;
    more than `most` cells are raked as a DataFrame.
    """
    if temper is not None:
        targets = {m: t for m, t in targets.items() if m != "source"}
    counted = common.written(cells(docs, columns, tokens, targets).fillna({"tokens": 0.0}))
    if temper is not None and counted.count() > most:
        return common.written(_swept(counted, targets, keep, temper))
    found = counted.toPandas()
    mass = found["tokens"].to_numpy(float)
    if temper is not None:
        sums = found[found["source"] != OTHER].groupby("source")["tokens"].sum()
        targets = {**targets, "source": dict.fromkeys(sums.index, 0.0) | tempered((sums / (sums.sum() or 1.0)).to_dict(), temper)}
    groups, wanted = [], []
    for m in MARGINS:
        names = [*targets[m], OTHER]
        groups.append(found[m].map({v: i for i, v in enumerate(names)}).to_numpy(np.int64))
        wanted.append(_wanted(targets[m], float(mass[found[m].to_numpy() == OTHER].sum() / mass.sum()) if mass.sum() else 0.0))
    found["rate"] = rake(mass, groups, wanted, keep, ROUNDS)
    schema = "source string, lang string, topic string, tokens double, documents long, rate double"
    return common.written(docs.sparkSession.createDataFrame(found[[c.split()[0] for c in schema.split(", ")]].values.tolist(), schema))


def _swept(counted: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float, temper: float) -> DataFrame:
    """`rake` over any number of sources: `counted` with the rate of each cell.

    A row has all cells of a source, so the step of the source margin is narrow; the other two margins need their sums over all
    rows, which are as few as the targets.  Tasks repeat the steps since the rates were last written.
    """
    names = {m: [*targets[m], OTHER] for m in ("lang", "topic")}
    n_topics = len(names["topic"])
    width = len(names["lang"]) * n_topics
    at = {m: F.array_position(F.array(*map(F.lit, names[m])), F.col(m)) - 1 for m in names}
    placed = counted.withColumn("k", (at["lang"] * n_topics + at["topic"]).cast("int"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.struct("k", "tokens"))), k), F.lit(0.0)))
    rows = common.written(placed.groupBy("source").agg(F.sum("tokens").alias("n"), dense.alias("mass")))
    own = F.col("source") != OTHER
    raised = F.when(own & (F.col("n") > 0), F.pow("n", F.lit(float(temper)))).otherwise(0.0)
    total, rest, powers = rows.agg(F.sum("n"), F.sum(F.when(own, 0.0).otherwise(F.col("n"))), F.sum(raised)).first()
    if not total:
        return counted.withColumn("rate", F.lit(float(keep)))
    rest = rest / total
    share = F.when(own, (1 - rest) * raised / (powers or 1.0)).otherwise(rest)
    even = F.array_repeat(F.lit(float(keep)), width)
    shares = 1.0 if powers else rest or 1.0
    state = common.written(rows.select("source", "mass", (keep * total / shares * share).alias("want"), even.alias("rate"), even.alias("before")))

    def run(batches, done, part, full):
        """The state after the rounds `done`, or the sums of each cell after `part` of a further one and the largest change."""
        sums, most = np.zeros(width), 0.0
        for b in batches:
            mass, rate, before = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("mass", "rate", "before"))
            want = b.column("want").to_numpy()

            def by_source(rate):
                now = (rate * mass).sum(axis=1)
                return np.minimum(1.0, rate * np.divide(want, now, out=np.ones_like(want), where=now > 0)[:, None])

            for factors in done:
                before, rate = rate, by_source(rate)
                for f in factors:
                    rate = np.minimum(1.0, rate * f)
            if full:
                lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (rate, before)]
                yield pa.RecordBatch.from_arrays([b.column("source"), b.column("mass"), b.column("want"), *lists], ["source", "mass", "want", "rate", "before"])
                continue
            most = max(most, np.abs(rate - before).max(initial=0))
            rate = by_source(rate)
            for f in part:
                rate = np.minimum(1.0, rate * f)
            sums += (rate * mass).sum(axis=0)
        if not full:
            yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64())), pa.array([most], pa.float64())], ["sums", "most"])

    def sums_after(done, part):
        some = state.mapInArrow(lambda batches: run(batches, done, part, False), "sums array<double>, most double")
        first = some.agg(F.max("most"), *(F.sum(F.col("sums")[k]) for k in range(width))).first()
        return np.array(first[1:], float), first[0]

    mass = np.array(rows.agg(*(F.sum(F.col("mass")[k]) for k in range(width))).first(), float)
    groups = {"lang": np.arange(width) // n_topics, "topic": np.arange(width) % n_topics}
    wants = {}
    for m, g in groups.items():
        there = np.bincount(g, mass)
        target = np.where(there > 0, _wanted(targets[m], there[-1] / total), 0.0)
        wants[m] = keep * total * target / (target.sum() or 1.0)
    done: list = []
    for turn in range(ROUNDS):
        part: list = []
        for m, g in groups.items():
            sums, change = sums_after(done, part)
            if m == "lang" and turn and change < CLOSE:
                break
            now = np.bincount(g, sums)
            part.append(np.divide(wants[m], now, out=np.ones_like(now), where=now > 0)[g])
        else:
            done = [*done, part]
            if len(done) == WRITE_EVERY:
                state = common.written(state.mapInArrow(lambda batches, done=done: run(batches, done, [], True), state.schema))
                done = []
            continue
        break
    last = state.mapInArrow(lambda batches: run(batches, done, [], True), state.schema)
    return placed.join(last.select("source", F.posexplode("rate").alias("k", "rate")), ["source", "k"]).select(*counted.columns, "rate")


def chance(doc_id: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for each id; rows without an id share one."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def with_rates(docs: DataFrame, columns: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float]], *, keep: float, temper: float | None = None, seed: int = 1, id_col: str = "doc_id") -> tuple[DataFrame, str, str]:
    """(`docs` with the rate of each row and whether it is kept, name of the rate column, name of the kept column).

    Rows with null values count as OTHER; repeated rows are kept or not kept together; an empty table stays empty.
    """
    rate, kept = common.free_name(docs, "rate"), common.free_name(docs, "kept")
    if temper is not None:
        targets = {m: t for m, t in targets.items() if m != "source"}
    found = rates(docs, columns, tokens, targets, keep=keep, temper=temper)
    mine = {m: common.free_name(docs, f"cell_{m}") for m in MARGINS}
    keyed = docs.select("*", *(v.alias(mine[m]) for v, m in zip(_values(columns, targets), MARGINS)))
    known = found.select(*(F.col(m).alias(mine[m]) for m in MARGINS), F.col("rate").alias(rate))
    out = keyed.join(known, list(mine.values()), "left").select(*docs.columns, F.coalesce(F.col(rate), F.lit(float(keep))).alias(rate))
    return out.withColumn(kept, chance(F.col(id_col), seed) < F.col(rate)), rate, kept
