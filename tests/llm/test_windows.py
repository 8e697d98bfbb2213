"""Periodic runs, filter audit and window removal against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pytest

from barloom.llm import filter_audit, periodic_runs, queries, window_dedup, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ── words ────────────────────────────────────────────────────────────────────
def test_words_are_runs_of_anything_but_blanks(monkeypatch):
    texts = ["", "  ", "one", " a  b\tc\n\nd\x0b\x0c\re ", "é ü  x", "\x1fz \x00 q", "last" * 40]
    for piece in (1, 7, 1 << 21):
        monkeypatch.setattr(words, "PIECE", piece)
        w = words.split([t.encode() for t in texts])
        assert w.counts.tolist() == [len(WORD.findall(t)) for t in texts]
        assert w.kept(np.ones(len(w.starts), bool)) == [" ".join(WORD.findall(t)) for t in texts]
    assert len(set(w.hashes.tolist())) == len({x for t in texts for x in WORD.findall(t)})
    assert words.split([]).kept(np.zeros(0, bool)) == []


# ── periodic runs ────────────────────────────────────────────────────────────
def slow_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def loops(rng, n):
    out = []
    while len(out) < n:
        part = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        out += (part * rng.randint(1, 9))[: rng.randint(1, 60)]
    return out[:n]


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_catchers_find_every_run(step, monkeypatch):
    monkeypatch.setattr(periodic_runs, "STEP", step)
    rng = random.Random(step)
    for _ in range(25):
        seqs = [loops(rng, rng.randint(0, 90)) if rng.random() < 0.6 else [rng.randint(0, 1) for _ in range(rng.randint(0, 70))] for _ in range(rng.randint(1, 6))]
        assert periodic_runs.runs_of([np.array(s, np.uint64) for s in seqs]) == [slow_runs(s) for s in seqs]


def test_words_without_overlaps_have_no_runs():
    thue = [0]
    while len(thue) < 1 << 14:
        thue += [1 - x for x in thue]
    assert periodic_runs.runs_of([np.array(thue, np.uint64)]) == [[]]


def slow_op11(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *head, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op11_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in loops(rng, rng.randint(0, 120))), "x") for i in range(120)]
    rows += [(None, "a a a a a a b", "x"), (500, None, "x"), (501, "", "x"), (7, "same same", "x"), (7, "same same", "x")]
    rows += [(502, "x y " * 40_000, "x"), (503, "\ta  b\na b a\x0bb a b ", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11(spark, str(tmp_path)).collect()]
    want = [slow_op11(i, t) for i, t, _ in rows if i != 502]
    assert sorted((r for r in got if r[0] != 502), key=str) == sorted(want, key=str)
    big = next(r for r in got if r[0] == 502)
    assert zlib.crc32(b"502") % 10 and big[1:6] == (1, 0, 80_000, 2, 40_000_000) and big[7] == sha("x y")
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, _ in rows[:120])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(periodic_runs.looped(empty)).count() == 0


# ── filter audit ─────────────────────────────────────────────────────────────
def test_constrained_fit_gives_shapley_values():
    rng = random.Random(2)
    for m in (1, 2, 3, 5):
        value = [0, *(rng.randint(-50, 50) for _ in range(2**m - 1))]
        want = [Fraction(0)] * m
        for order in permutations(range(m)):
            before = 0
            for i in order:
                want[i] += Fraction(value[before | 1 << i] - value[before], factorial(m))
                before |= 1 << i
        assert filter_audit.shapley(value) == want


def slow_audit(rows, marks):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    docs = []
    for i, t, part in rows:
        w, t = WORD.findall(t or ""), t or ""
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and texts[t] < i
        mine = [m for m in marks if i is not None and m[0] == i]
        docs.append((part or "", fails, any(m[1] == 1 for m in mine), any(m[2] == 1 for m in mine)))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                failing = sum(d[1][x] for d in mine)
                alone = sum(d[1][x] and sum(d[1].values()) == 1 for d in mine)
                total[x] += len(gone)
                found.append([part, "".join(order), k, len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [(*f, total[f[1][f[2] - 1]]) for f in found]
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(8)
    long = " ".join(f"word{i}" for i in range(220))
    texts = ["", None, "A B C", "few words # here", long, long + " $", "UP " * 210, "dull " * 210, long.upper(), "a" * 90_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["x", "y", None, ""])) for _ in range(90)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert sorted(got) == sorted(slow_audit(rows, marks))
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.where("false")).count() == len(got)


def test_audit_takes_filters_of_ones_own(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "aa", "s"), (2, "aa", "s"), (3, "b", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(docs, labels, filters={"L": F.length("text") > 1}, copies="T").collect()}
    assert [got["LT", 1].removed, got["LT", 2].removed, got["LT", 2].redundant] == [2, 0, 1]
    assert [got["TL", 1].removed, got["TL", 1].good_lost, got["TL", 2].removed] == [1, 1, 1]
    assert got["LT", 1].shapley == 3 and got["LT", 2].shapley == 1


# ── window removal ───────────────────────────────────────────────────────────
def slow_windows(rows, window):
    first = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("chunk", "piece"), [(1, 1), (300, 64), (4_000_000, 1 << 12), (4_000_000, 1 << 25)])
def test_windows_equal_brute_force(spark, chunk, piece):
    rng = random.Random(chunk + piece)
    pieces = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    rows = [(rng.choice([None, *range(30)]), "  ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))), "x") for _ in range(70)]
    rows += [(50, None, "x"), (51, "", "x"), (2**63 - 1, rows[0][1], "x"), (-5, rows[1][1], "x")] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(5)
    got = window_dedup.without_repeated_windows(docs, window=4, chunk_chars=chunk, slice_bytes=piece)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(slow_windows(rows, 4), key=str)


def test_windows_of_empty_and_long_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert window_dedup.without_repeated_windows(empty).count() == 0
    rng = random.Random(3)
    long = " ".join(f"{rng.random():.12f}" for _ in range(350_000))  # longer than a chunk
    rows = [(2, "head " + long + " tail"), (1, long), (3, "short text"), (4, "short text")]
    got = {r.doc_id: r for r in window_dedup.without_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].kept, got[2].n_removed, got[1].n_removed, got[4].n_removed) == ("head tail", 350_000, 0, 0)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    grid = window_dedup.Grid.of(4096, 1024)
    raw = [" ".join(map(str, rng.integers(0, 6, 300))).encode() for _ in range(6)]
    found = window_dedup.Windows(raw, np.arange(6), np.ones(6, bool), 5)
    for cells, many, place in found.cells(grid):
        assert many[place][found.several].all() and (np.diff(cells.astype(np.int64)) > 0).all()
        body = [(cells & grid.mask, many)] * window_dedup.ROWS if grid.bits == 0 else None
        if body:
            back = window_dedup._read_sketch(window_dedup._sketch(body, grid.mask))
            assert (back[0][0] == body[0][0]).all() and (back[1][1] == body[1][1]).all()
