"""Classifiers, mixing, neighbours, the pipeline and the registered queries."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from barloom.llm import common, labelled, mixing, neighbours, quality, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng = random.Random(4)
    plain = ["river", "stone", "window", "garden", "paper", "green", "walk", "seven"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 80))]
        bad = i % 3 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["grumbled", "grumbling", "grumbler"])
        text = " ".join(words)
        junk = i % 4 == 1
        rows.append((i, " | ".join(words) + " ###" if junk else text, "q"))
        labels.append((i, 0 if junk else 1, int(bad)))
    labels += [(1000, 1, 1), (None, 1, 1), (5, None, None)]
    rows += [(2000, None, "q"), (2001, "", "q"), (None, "river stone", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,folds,fold,thr", [(quality, "quality", 3, 1, 0.5), (toxicity, "toxic", 4, 2, 0.3)])
def test_classifiers_hold_out(spark, labelled_docs, module, label, folds, fold, thr):
    docs, labels = labelled_docs
    model = module.fit(docs, labels)
    got = module.score(docs, model).join(labels, "doc_id").where(f"held_out and {label} is not null").collect()
    assert len(got) > 50 and np.mean([r.predicted == r[label] for r in got]) > 0.9
    every = module.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= thr) for r in every)
    again = {r.doc_id: r.score for r in module.score(docs, module.fit(docs.repartition(7), labels)).collect()}
    assert again == {r.doc_id: r.score for r in every}
    none = module.fit(docs, labels.where("false"))
    assert len({r.score for r in module.score(docs, none).collect()}) == 1
    assert module.score(docs.where("false"), module.fit(docs.where("false"), labels)).count() == 0


def test_sample_keeps_out_the_fold(spark, labelled_docs):
    docs, labels = labelled_docs
    few, counts = labelled.sample(docs, labels, "toxic", folds=4, fold=2, per_class=10)
    rows = few.collect()
    import zlib

    assert len(rows) == 20 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
    assert sum(counts.values()) == sum(1 for r in labels.dropna().collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)


def test_pairs_weigh_more_than_their_sum():
    """Bad is one of two terms without the other: no additive model can tell."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(600):
        a, b = rng.random(2) < 0.5
        docs.append(np.array([t for t, on in ((1, a), (2, b)) if on] + [3 + rng.integers(5)], np.int32))
        labels.append(float(a != b))
    values = [np.full(len(d), 0.7, np.float32) for d in docs]
    model = toxicity.train(docs, values, np.array(labels), epochs=60, rate=10.0, shrink=0.0)
    at = {t: i for i, t in enumerate(model.ids.tolist())}
    w, pair = model.linear, model.factors[at[1]] @ model.factors[at[2]] * 0.49
    one, two = model.bias + 0.7 * w[at[1]], model.bias + 0.7 * (w[at[1]] + w[at[2]]) + pair
    assert pair < -1 and one > 0.5 and two < -0.5


def test_terms_neutral_alone_count_in_pairs():
    """Every term is as frequent in both classes, so that no linear weight stays; production defaults must learn the pairs."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        docs.append(np.array([1 if a else 2, 3 if b else 4, 5 + rng.integers(40), 45 + rng.integers(40)], np.int32))
        labels.append(float(a == b))
    model = toxicity.train(docs, [np.full(4, 0.5, np.float32)] * 1200, np.array(labels))
    at = {t: i for i, t in enumerate(model.ids.tolist())}
    right = 0
    for d, y in zip(docs, labels):
        row = [at[t] for t in d.tolist() if t in at]
        vx = 0.5 * model.factors[row]
        odds = model.bias + 0.5 * model.linear[row].sum() + ((vx.sum(axis=0) ** 2).sum() - (vx * vx).sum()) / 2
        right += (odds > 0) == (y == 1)
    assert {1, 2, 3, 4} <= set(at) and right > 0.95 * 1200


def slow_toxic_odds(model, text):
    """The factorization machine term by term and pair by pair."""
    raw = text.lower().encode()
    words = [w for w in re.split(rb"[^a-z\x80-\xff]+", raw) if w]
    codes = [list(w) for w in words]
    hashed = []
    for w in codes:
        total = sum(int(common.mixed_codes(np.array([c], np.uint32))[0]) * pow(int(common.BASE), j, 1 << 64) for j, c in enumerate(w)) + len(w)
        hashed.append(total % (1 << 64))
        edged = [32, *w, 32]
        pieces = [(5, edged[i : i + 5]) for i in range(len(edged) - 4)] + ([(6, edged[:6])] if len(w) >= 5 else [])
        for n, piece in pieces:
            packed = n
            for c in piece:
                packed = (packed << 8 | c) % (1 << 64)
            hashed.append(-1 - packed)
    counts = {}
    for x in hashed:
        # words are mixed twice: once as a slice, once as a term
        term = int(toxicity._term(common.mix(np.array([x], np.uint64)))[0]) if x >= 0 else int(toxicity._term(np.array([-1 - x], np.uint64))[0])
        counts[term] = counts.get(term, 0) + 1
    at = {t: i for i, t in enumerate(model.ids.tolist())}
    x = {at[t]: (n / max(1, len(words))) ** 0.5 for t, n in counts.items() if t in at}
    odds = model.bias + sum(model.linear[i] * v for i, v in x.items())
    return odds + sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))


def test_toxicity_scores_equal_plain_loops(spark, labelled_docs):
    docs, labels = labelled_docs
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()} | {3000: "Ünder grumbling, GRUMBLED! a-b " * 3}
    extra = spark.createDataFrame([(3000, texts[3000])], "doc_id long, text string")
    for r in toxicity.score(docs.select("doc_id", "text").where("doc_id is not null and doc_id % 9 in (0, 2)").union(extra), model).collect():
        assert np.isclose(r.score, 1 / (1 + np.exp(-slow_toxic_odds(model, texts[r.doc_id]))), rtol=1e-8)


def test_quality_scores_equal_plain_loops(spark, labelled_docs):
    docs, labels = labelled_docs
    model = quality.fit(docs, labels)
    for r in quality.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").where("doc_id % 9 in (0, 2)").collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        found = []
        for i, w in enumerate(words):
            total = sum(int(common.mixed_codes(np.array([c], np.uint32))[0]) * pow(int(common.BASE), j, 1 << 64) for j, c in enumerate(w)) + len(w)
            found.append(int(common.mix(np.array([total % (1 << 64)], np.uint64))[0]))
            if i and words[i - 1] == w:
                found.append(1)
            edged = b" " + w + b" "
            found += [int.from_bytes(bytes([n]) + edged[j : j + n], "big") for n in (3, 4) for j in range(len(edged) - n + 1)]
        weights = [float(model.weights[quality._bucket(np.array([x], np.uint64))[0]]) for x in found]
        odds = model.bias + (sum(weights) / len(weights) if weights else 0.0)
        assert np.isclose(r.score, 1 / (1 + np.exp(-odds)), rtol=1e-6), r.doc_id


def test_factor_step_is_chosen_on_training_rows_alone(spark, labelled_docs, monkeypatch):
    """Labels of the held-out fold may say anything; the choice sees each training row through models that did not."""
    docs, labels = labelled_docs
    seen = []
    chosen = toxicity.chosen_step

    def watch(found, values, y, choices):
        seen.append((sorted(len(f) for f in found), sorted(y.tolist())))
        return chosen(found, values, y, choices)

    monkeypatch.setattr(toxicity, "chosen_step", watch)
    a = toxicity.fit(docs, labels)
    turned = labels.withColumn("toxic", F.when(labelled.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity.fit(docs, turned)
    assert seen[0] == seen[1] and a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_chosen_step_has_the_least_loss(monkeypatch):
    rng = np.random.default_rng(2)
    docs = [np.unique(rng.integers(0, 30, 6)).astype(np.int32) for _ in range(80)]
    values = [np.full(len(d), 0.5, np.float32) for d in docs]
    labels = np.array([float(3 in d or 4 in d) for d in docs])
    part = np.random.default_rng(23).permutation(80) % 2
    losses = {}
    for slower in (4.0, 12.0, 40.0):
        total = 0.0
        for k in (0, 1):
            model = toxicity.train([d for d, p in zip(docs, part) if p != k], [v for v, p in zip(values, part) if p != k], labels[part != k], slower=slower)
            for d, v, y, p in zip(docs, values, labels, part):
                if p == k:
                    odds = model.odds_of([d], [v])[0]
                    total += np.log1p(np.exp(-odds if y else odds))
        losses[slower] = total
    assert toxicity.chosen_step(docs, values, labels, (4.0, 12.0, 40.0)) == min(losses, key=losses.get)
    assert toxicity.chosen_step(docs, values, np.zeros(80), (4.0, 12.0)) == 12.0


def test_clean_rows_stay(spark, labelled_docs):
    docs, labels = labelled_docs
    model = toxicity.fit(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


# ── mixing ───────────────────────────────────────────────────────────────────
def test_raking_meets_every_margin():
    rng = np.random.default_rng(2)
    mass = rng.integers(50, 200, 60).astype(float)
    groups = [np.arange(60) % 4, np.arange(60) // 4 % 3, np.arange(60) // 12]
    targets = [np.full(4, 0.25), np.array([0.4, 0.35, 0.25]), np.full(5, 0.2)]
    rate = mixing.rake(mass, groups, targets, 0.5)
    kept = rate * mass
    assert rate.max() <= 1 and abs(kept.sum() - mass.sum() / 2) < 1e-6 * mass.sum()
    for g, t in zip(groups, targets):
        assert np.allclose(np.bincount(g, kept) / kept.sum(), t, atol=1e-6)
    assert mixing.rake(np.zeros(3), [np.arange(3)], [np.full(3, 1 / 3)], 0.5).tolist() == [0.5] * 3


def test_mixing_samples_toward_the_targets(spark):
    df = spark.range(20000).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) as source", "if(id % 4 = 0, 'de', if(id % 97 = 1, null, 'en')) as lang", "'x' as topic",
        "10 as n", "1 as rate", "'k' as kept", "'c' as cell_source",
    )
    from pyspark.sql import functions as F

    columns = {m: F.col(m) for m in mixing.MARGINS}
    targets = {"source": {"hot": 0.2, **{f"s{i}": 0.16 for i in range(5)}}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 1.0}}
    out, rate, kept = mixing.with_rates(df, columns, F.col("n"), targets, keep=0.4)
    assert out.columns == [*df.columns, rate, kept] and out.count() == 20000
    got = out.where(kept).groupBy("source").count().collect()
    total = sum(r["count"] for r in got)
    assert abs(total - 8000) < 400 and all(abs(r["count"] / total - targets["source"][r["source"]]) < 0.03 for r in got)
    assert mixing.with_rates(df.where("false"), columns, F.col("n"), targets, keep=0.4)[0].count() == 0


@pytest.mark.parametrize("most", [mixing.DRIVER_CELLS, 0])
def test_every_source_is_raked(spark, most):
    """150 sources, the small ones too, in the driver and as a DataFrame: every margin is met, no source is pooled."""
    from pyspark.sql import functions as F

    df = spark.range(60000).selectExpr(
        "id as doc_id", "if(id % 601 = 1, null, concat('s', cast(sqrt(id % 22500) as int))) as source", "if(hash(id) % 5 = 0, 'de', 'en') as lang",
        "if(hash(id, 1) % 7 = 0, null, 'prose') as topic", "1 + pmod(hash(id, 2), 9) as n",
    )
    targets = {"lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 1.0}}
    found = mixing.rates(df, {m: F.col(m) for m in mixing.MARGINS}, F.col("n"), targets, keep=0.3, temper=0.8, most=most).toPandas()
    assert found["source"].nunique() == 151 and found["documents"].sum() == 60000
    kept = (found["rate"] * found["tokens"]).groupby(found["source"]).sum()
    had = found.groupby("source")["tokens"].sum()
    named = had.drop(mixing.OTHER)
    want = mixing.tempered((named / had.sum()).to_dict(), 0.8)
    rest = had[mixing.OTHER] / had.sum()
    assert abs(kept.sum() - 0.3 * had.sum()) < 1e-6 * had.sum() and abs(kept[mixing.OTHER] / kept.sum() - rest) < 1e-6
    assert all(abs(kept[s] / kept.sum() - (1 - rest) * want[s]) < 1e-6 for s in want)
    lang = (found["rate"] * found["tokens"]).groupby(found["lang"]).sum() / kept.sum()
    assert abs(lang["de"] - 0.4) < 1e-6
    assert mixing.rates(df.where("false"), {m: F.col(m) for m in mixing.MARGINS}, F.col("n"), targets, keep=0.3, temper=0.8, most=-1 if not most else most).count() == 0


def test_sweeps_equal_the_driver_where_rates_are_full(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "ROUNDS", 20)  # these targets need more rounds to settle; 20 include a write of the rates
    df = spark.range(4000).selectExpr(
        "id as doc_id", "concat('s', cast(pow(id % 1000, 0.45) as int)) as source", "if(id % 11 < 9, 'en', if(id % 2 = 0, 'de', 'xx')) as lang",
        "if(hash(id) % 13 = 0, 'code', 'prose') as topic", "1 + pmod(hash(id, 2), 90) as n",
    )
    targets = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.3}, "topic": {"prose": 0.9, "code": 0.1}}
    got = [
        {(r.source, r.lang, r.topic): r.rate for r in mixing.rates(df, {m: F.col(m) for m in mixing.MARGINS}, F.col("n"), targets, keep=0.8, temper=0.5, most=most).collect()}
        for most in (mixing.DRIVER_CELLS, 0)
    ]
    assert got[0].keys() == got[1].keys() and max(got[0].values()) == 1.0 and all(abs(got[0][k] - got[1][k]) < 1e-8 for k in got[0])


# ── neighbours ───────────────────────────────────────────────────────────────
def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    data[100:400] = data[0]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    rows += [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [None] + [1.0] * 15, 1), (5150, [float("nan")] * 16, 1), (5200, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    from pyspark.sql import functions as F

    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, k=5, leaf_size=20, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = data.astype(float)
    norm = np.sqrt((x * x).sum(axis=1))
    hit = total = 0
    for q in range(0, 3000, 50):
        score = neighbours.cosines(np.repeat(x[q : q + 1], 3000, axis=0), x)
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - score[m[1]]) < 1e-12 for m in mine)
        hit += len(set(order) & {m[1] for m in mine})
        total += 5
        if 100 <= q < 400:
            assert [m[1] for m in mine] == order
    assert set(got) == set(range(0, 3000, 50)) and hit / total >= 0.9 and norm.min() > 0
    assert neighbours.search(df.where("vec_id >= 5000"), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.search(df.where("vec_id in (0, 450, 451)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (450, 1), (450, 2)]


def test_default_recall_target():
    import inspect

    assert inspect.signature(neighbours.search).parameters["recall"].default >= 0.97


def test_best_bins_visit_every_leaf_once():
    x = neighbours.units(np.random.default_rng(0).normal(size=(500, 8)))
    tree = neighbours.Tree.fit(x, leaf_size=10)
    order = tree.best_bins(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.leaf_of(x[:1])[0] or tree.leaves > 1
    assert neighbours.Tree.fit(np.ones((100, 4))).leaves == 1


# ── pipeline and queries ─────────────────────────────────────────────────────
def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    before = docs.count()
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("rate", docs["doc_id"].isNull())
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > before / 3
    packed = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_links_from_eighty_percent(spark):
    """Of 100 shingles each, two pairs share 0.80 to 0.85, a third one 0.77."""
    rows = []
    for base, cut in ((0, 9), (10, 10)):
        words = [f"w{base}x{i}" for i in range(104)]
        other = words[: 104 - cut] + [f"v{base}x{i}" for i in range(cut)]
        first, second = ({tuple(w[i : i + 5]) for i in range(100)} for w in (words, other))
        share = len(first & second) / len(first | second)
        assert 0.8 <= share < 0.85
        rows += [(base, " ".join(words), "en", "s", 1), (base + 1, " ".join(other), "en", "s", 1)]
    far = [f"u{i}" for i in range(104)]
    rows += [(20, " ".join(far), "en", "s", 1), (21, " ".join(far[:91] + [f"t{i}" for i in range(13)]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()) == [0, 10, 20, 21]


def test_every_operator_has_a_query():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_cuts_a_shared_passage_from_both(spark):
    passage = " ".join(f"pass{i}" for i in range(60))
    rows = [(1, f"alpha one two {passage} omega"), (2, f"beta {passage} three four"), (3, "clean text of its own " * 3), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_passages(spark, docs, SF).collect()}
    assert "pass30" not in got[1] and "pass30" not in got[2] and got[1].startswith("alpha one two") and got[2].endswith("three four")
    assert got[3] == rows[2][1] and got[4] is None
