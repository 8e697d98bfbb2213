"""Token counts, packing and the id store against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import id_store, packing, pretokens, token_counts, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens int, length int, key string"  # with names that the operators use themselves
ODD = [
    "", " ", "\n\n x", "it's we'll 's ''s don't'", "<|endoftext|>a<|endoftext|><|endoftext|> b", "x <|endoftext|>", "　 a\xa0\xa0b",
    "a\x00b\x1c\x1d c", "café naïve 中文 \U0001f600\U0001f600", "1234 ²Ⅷ x9", "word " * 3000, "z" * 500, "\t\t 'tis", "'re'",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in t.encode_batch_fast(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], 1, 2, "k"), (100, None, None, None, None), (None, "no id", 1, 1, "k")]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_pieces_and_ids_equal_the_library(library):
    rng = random.Random(3)
    letters = list("ab1 '\n\t.sltredvmé 　中\U0001f600\x00\x1c\x85²Ⅷ​")
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = library(texts)
    flat, n = token_ids.encode(texts, PATH, 7)
    assert np.array_equal(flat, np.concatenate([[*w, 7] for w in want])) and n.tolist() == [len(w) + 1 for w in want]
    assert token_counts.counts_of(texts, PATH).tolist() == [len(w) for w in want]


def test_a_full_table_of_pieces_starts_anew():
    known = pretokens.PieceTable(lambda ps: [(len(p),) for p in ps], most=3)
    for words in (["a", "bb"], ["ccc", "dddd", "a"], ["bb", "a", "e" * 100]):
        joined, codes, s, e, _, _ = pretokens.split(words)
        rows = known.rows_of(joined, codes, s, e)
        assert known.flat[known.starts[rows]].tolist() == [len(w) for w in words]


def test_counts(spark, docs, library):
    got = sorted(rows_of(token_counts.count_tokens(docs, PATH, limit=5)), key=str)
    src = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = library(t for _, t in src)
    assert got == sorted(((i, len(t.encode()), len(x), len(x) > 5) for (i, t), x in zip(src, ids)), key=str)
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("window", [8, 2048])
def test_packing(spark, docs, library, window):
    out = packing.pack(docs, PATH, window=window, end_id=1, group_docs=5, with_ids=True).collect()
    whole, room = {}, {}
    for r in out:
        whole.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r)
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for spans in room.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    src = [(r.doc_id, r.text or "") for r in docs.collect()]
    for (i, _), ids in zip(src, library(t for _, t in src)):
        parts = whole[i, len(ids) + 1]
        assert [x for s in sorted(parts) for x in parts[s][0].ids] == [*ids, 1]
        assert {len(p) for p in parts.values()} == {2 if i == 3 else 1}
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    rooms: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[i])
        else:
            rooms.append(100 - lengths[i])
    used = np.bincount(bins, lengths)
    assert sorted(100 - used) == sorted(rooms) and offsets.min() == 0


def test_perfect_hash_is_minimal_and_finds_its_keys():
    keys = np.sort(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    hashes = id_store.key_hash(keys, id_store.turns(keys))
    found = id_store.PerfectHash.of(hashes)
    assert sorted(found.slots(hashes)) == list(range(5000))
    again = id_store.PerfectHash.load(found.dump())
    assert np.array_equal(again.slots(hashes), found.slots(hashes))


def test_store(spark, docs, library, tmp_path):
    manifest = id_store.write(docs, PATH, str(tmp_path / "ids"), end_id=2, shard_docs=4)
    got = rows_of(id_store.read_all(manifest))
    src = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, at = [], 0
    for (i, _), ids in zip(src, library(t for _, t in src)):
        raw = np.array([*ids, 2], "<u4")
        want.append((i, at, len(raw), zlib.crc32(raw.tobytes())))
        at += len(raw)
    assert sorted(got, key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(4,), (77,), (None,), (13,)], "doc_id long")
    found = {r.doc_id: r.ids for r in id_store.fetch(manifest, asked).collect()}
    assert found[77] is None and found[4] == [*library([ODD[4]])[0], 2] and found[None] == [*library(["no id"])[0], 2]
    assert id_store.read_all(id_store.write(docs.where("false"), PATH, str(tmp_path / "none"))).count() == 0


def test_shard_gives_one_document(spark, docs, library, tmp_path):
    manifest = id_store.write(docs, PATH, str(tmp_path / "ids"), shard_docs=100)
    with id_store.Shard(manifest.first().file) as shard:
        assert shard.get(8).tolist() == [*library([ODD[8]])[0], 2]
        assert shard.get(3, 1).tolist() == shard.get(3).tolist() and shard.get(3, 2) is None and shard.get(-5) is None
