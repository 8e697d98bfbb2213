"""Fingerprints, near-duplicates and repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from barloom.llm import near_dup, repeats, winnowing
from barloom.llm.components import components
from barloom.llm.rlbwt import RunLengthIndex


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ── winnowing ────────────────────────────────────────────────────────────────
def slow_fingerprint(text, k, window):
    if not text:
        return []
    if len(text) < k:
        return [(text, 0)]
    from barloom.llm import common

    codes = common.code_points(text)
    at = np.arange(len(text) - k + 1)
    grams = common.slice_hash(common.prefix_hash(codes), at, at + k).tolist()
    out = []
    for s in range(max(1, len(grams) - window + 1)):
        part = grams[s : s + window]
        best = max(i for i, g in enumerate(part) if g == min(part)) + s
        if best not in out:
            out.append(best)
    return [(grams[i], i) for i in out]


def test_windows_choose_the_rightmost_minimum():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 90))) for _ in range(120)]
    got = winnowing.fingerprints_of(texts, 4, 7)
    for t, (h, p) in zip(texts, got):
        want = slow_fingerprint(t, 4, 7)
        assert p.tolist() == [x[1] for x in want]
        if len(t) >= 4:
            assert h.tolist() == [x[0] for x in want]


def test_a_shared_passage_shares_a_fingerprint():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(winnowing.K + winnowing.WINDOW - 1)
    a, b = winnowing.fingerprints_of([word(100) + passage + word(50), word(33) + passage + word(200)])
    assert set(a[0].tolist()) & set(b[0].tolist())


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_edits_take_the_next_document(spark, block):
    rows = [(5, "alpha beta gamma " * 5, "x"), (3, None, "x"), (9, "delta épsilon " * 9, "x"), (1, "zeta", "x"), (7, "", "x"), (7, "seven again", "x"), (None, "last one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string")
    order = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), t == edit, t == nxt))
    import barloom.llm.winnowing as w

    keep, w.with_neighbours.__kwdefaults__["block_docs"] = w.with_neighbours.__kwdefaults__["block_docs"], block
    try:
        got = w.compare_with_edits(df, k=4, window=5).collect()
    finally:
        w.with_neighbours.__kwdefaults__["block_docs"] = keep
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == sorted([x[:3] for x in want], key=str)
    slow = lambda t: {h for h, _ in slow_fingerprint(t, 4, 5)}
    nears = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        nears.append((i, len(t), *(len(slow(t) & slow(o)) / len(slow(t) | slow(o)) if slow(t) | slow(o) else 1.0 for o in (edit, nxt))))
    assert sorted([(r.doc_id, r.n_chars, r.near_edited, r.near_next) for r in got], key=str) == sorted(nears, key=str)
    same = {x[0] for x in want if x[3]}
    assert all(r.fingerprint == r.edited_fingerprint and r.near_edited == 1 for r in got if r.doc_id in same - {7})
    assert w.compare_with_edits(df.where("false")).count() == 0


def test_lone_document_follows_itself(spark):
    (r,) = winnowing.compare_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert winnowing.fingerprints(spark.createDataFrame([(1, None), (2, "abcd")], "doc_id long, text string")).count() == 2


# ── near-duplicates ──────────────────────────────────────────────────────────
def word_set(text):
    low = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow_components(rows, percent=85):
    sets = {i: word_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, size, edits, words=140, start=0):
    """Copies of one text, each with up to so many words changed: most links run through few of them."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        text = list(base)
        for _ in range(rng.choice(edits)):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**9)}"
        out.append((start + i, " ".join(text)))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = family(rng, 90, [0, 1, 1, 2, 3, 4, 5]) + family(rng, 60, [1, 2, 3, 3, 4], start=200) + family(rng, 20, [0, 1], words=40, start=400)
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE two"), (505, "one  two three four five"), (506, rows[0][1].upper())]
    rows += [(600 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(30))) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "b", "c") for i, t in rows], "doc_id long, text string, n_shingles int, bands string, digest string")
    found = near_dup.near_duplicates(df)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == slow_components(rows)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {x[0] for x in got if x[3]}


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(2, text), (2, text), (4, text), (None, text), (None, "other words stand in this text")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 2, True), (2, 2, True), (4, 2, False), (None, 2, False), (None, None, True)], key=str)
    assert near_dup.near_duplicates(df.where("false")).count() == 0
    assert sorted(r.doc_id for r in near_dup.keep_one(df.where("doc_id is not null")).collect()) == [2]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = dict(rows_of(components(links)))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ── repeats ──────────────────────────────────────────────────────────────────
def slow_removal(raw, length):
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_index_counts_and_matches_like_a_search():
    rng = random.Random(2)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(1, 60)))
        parts = [base[rng.randrange(len(base)) :][: rng.randint(1, 40)] + bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([0, 5]))) for _ in range(rng.randint(1, 8))]
        index, n = RunLengthIndex(parts), rng.randint(1, 12)
        match = index.matching_statistics(n)
        windows = [p[i : i + n] for p in parts for i in range(len(p) - n + 1)]
        for p, start in zip(parts, index.starts):
            for i in range(len(p) - n + 1):
                assert (match[start + i] >= n) == (windows.count(p[i : i + n]) > 1)
        wanted = parts[0][:3]
        assert index.count(wanted) == sum(p[i : i + len(wanted)] == wanted for p in parts for i in range(len(p)))
        assert index.runs == len(index.run_lengths) and len(index.transform()) == len(index.codes)


def repeat_rows():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh é中") for _ in range(n))
    passage = word(150)
    rows = [(i, word(rng.randint(0, 120)) + passage[rng.randint(0, 30) : 150 - rng.randint(0, 30)] + word(rng.randint(0, 90))) for i in range(40)]
    copy = word(200)
    return rows + [(50, copy), (51, copy), (52, copy[:100] + "#" + copy[100:]), (60, None), (61, ""), (62, "short"), (63, "abc" * 60), (64, word(90) * 2), (50, copy)]


@pytest.mark.parametrize("huge", [False, True])
def test_repeats_equal_brute_force(spark, huge, monkeypatch):
    if huge:
        monkeypatch.setattr(repeats, "GROUP_FRAGMENTS", 3)
    rows = repeat_rows()
    df = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], "doc_id long, text string, key string, spans string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, length=80).collect())
    want = slow_removal([(t or "").encode() for _, t in rows], 80)
    assert got == sorted((i, *w) for (i, _), w in zip(rows, want))
    left = repeats.drop_repeats(df, length=80)
    assert left.columns == df.columns and left.count() == len(rows)
    assert {r.doc_id: r.text for r in left.collect()}[60] is None and {r.doc_id: r.text for r in left.collect()}[50] == ""


def test_no_rows_no_repeats(spark):
    df = spark.createDataFrame([(None, "x" * 50), (1, "y" * 10)], "doc_id long, text string")
    assert repeats.without_repeats(df.where("false"), length=20).count() == 0
    got = {r.doc_id: r.n_removed for r in repeats.without_repeats(df, length=20).collect()}
    assert got == {None: 50, 1: 0}


def slow_keepers(rows, percent):
    """Indexes of the rows that stay: the least (id, hash of the text) of each component, texts without words always."""
    def shingles(t):
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    return sets, group


def test_every_id_is_an_id(spark):
    base = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefghijk"]
    near = lambda t: t + " more"
    rows = [
        (2**62 + 5, base[0]), (2**62 + 9, base[1]), (2**63 - 1, base[2]), (2**62 - 1, near(base[2])), (-(2**63), base[3]), (7, near(base[3])),
        (None, base[4]), (None, base[4].replace(" ", "  ")), (None, base[4]), (None, base[5]), (3, near(base[5])),
        (11, base[6]), (11, base[7]), (12, base[7]), (13, base[8]), (13, base[8]), (1, base[9]), (1, near(base[9])), (None, ""), (None, ""), (14, None), (14, None),
    ]
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, key int, root string")
    sets, group = slow_keepers(rows, 80)
    got = near_dup.near_duplicates(docs, percent=80).collect()
    want = []
    for (i, _), s, g in zip(rows, sets, group):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None]
        least = min(ids, default=None) if s else i
        want.append((i, len(s), least, i == least))
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == sorted(want, key=str)

    kept = near_dup.keep_one(docs, percent=80)
    assert kept.columns == docs.columns
    stay = sorted(r.key for r in kept.collect())
    for g in set(group):
        members = [k for k in range(len(rows)) if group[k] == g]
        here = [k for k in stay if k in members]
        if not sets[members[0]]:
            assert here == members
            continue
        assert len(here) == 1
        assert (rows[here[0]][0] is None, rows[here[0]][0] or 0) == min((rows[k][0] is None, rows[k][0] or 0) for k in members)
    assert near_dup.keep_one(docs.where("false")).count() == 0


def test_batches_are_handed_out_in_light_slices():
    import pyarrow as pa

    from barloom.llm import common

    texts = ["ab", None, "", "cdefgh", "i" * 50, "", "j", "k"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(8))], ["text", "n"])
    for limit in (1, 5, 60, 1000):
        parts = list(common.light([batch, batch.slice(0, 0)], limit=limit))
        assert [x for p in parts for x in p.column("text").to_pylist()] == texts and [x for p in parts for x in p.column("n").to_pylist()] == list(range(8))
        assert all(p.num_rows and (p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= limit) for p in parts)
