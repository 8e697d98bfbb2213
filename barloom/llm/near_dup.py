"""Near-duplicates by b-bit MinHash.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes), 128 minima over it, 32 band keys of four
   minima each, and the low two bits of each minimum, packed as four longs.  Texts with equal sets are one class from here on.
2. Classes that share a band key meet.  In each bucket every class is compared with the bucket's least class: sizes, then the
   collision-corrected similarity from bit counts of the packed signatures, then the full sets.
3. Confirmed links give components.  Buckets whose classes are not in one component yet are opened again, and links between
   components there are found by what their classes do not share with a pivot (`_across`).  So each pair of a bucket is in one
   component, has been compared, or cannot be similar; no bucket is capped, and copies of one template never make all pairs.

At a similarity of 0.85 a pair shares no band with probability (1 - 0.85**4)**32 < 1e-10 (below 1e-7 at 0.8), and the signature test, set six
standard deviations below, loses less still.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.components import components

WORDS = 5
BANDS, ROWS, BITS = 32, 4, 2
SLOTS = BANDS * ROWS

_SEEDS = common.mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * common.BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are runs of anything but blanks and the controls 9 to 13, with A-Z in lower case.  A text with fewer than
    `words` words is one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for lo, hi in common.chunks(texts):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        joined = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends_of = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        codes = _LOWER[joined]
        blank = _BLANK[codes]
        edge = np.diff(blank.astype(np.int8), prepend=1)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = common.slice_hash(common.prefix_hash(codes), starts, ends)
        prefix = np.zeros(len(word) + 1, np.uint64)
        up, down = common.powers(len(word) + 1)
        np.cumsum(word * up[: len(word)], out=prefix[1:])
        first = np.searchsorted(starts, np.append(0, ends_of[:-1]))
        last = np.append(first[1:], len(starts))
        at = np.arange(max(0, len(word) - words + 1))
        grams = common.mix((prefix[at + words] - prefix[at]) * down[at] + np.uint64(words))
        for a, b in zip(first.tolist(), last.tolist()):
            n = b - a
            if n >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif n:
                out.append(common.mix((prefix[b : b + 1] - prefix[a : a + 1]) * down[a : a + 1] + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """SLOTS minima of each set; the sets are not empty."""
    out = np.empty((len(sets), SLOTS), np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo, 0
        while hi < len(sets) and (size == 0 or size + len(sets[hi]) <= 60_000):
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        cuts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for j in range(SLOTS):
            out[lo:hi, j] = np.minimum.reduceat((flat ^ _SEEDS[j]) * (_SEEDS[SLOTS + j] | np.uint64(1)), cuts)
        lo = hi
    return out


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) of rows of minima: the planes of bit 0 and bit 1, two longs each."""
    keys = np.zeros((len(least), BANDS), np.uint64)
    for r in range(ROWS):
        keys = common.mix(keys * common.BASE + least[:, r::ROWS])
    keys = common.mix(keys + np.arange(BANDS, dtype=np.uint64) * common.BASE)
    mixed = common.mix(least)
    planes = [np.packbits(((mixed >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view("<i8") for b in range(BITS)]
    return keys.view(np.int64), np.concatenate(planes, axis=1)


SKETCH = "key struct<nameless:boolean,id:long,tag:long>, doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts with a key of their own that sorts by id; rows without one come last, by a hash of their text."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("tag"))
    return common.keyed_texts(docs, id_col, text_col).withColumn("key", key)


def sketches(docs: DataFrame, *, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its key, set size, digest, bands, bits."""

    def run(batches):
        for b in common.light(batches):
            sets = shingle_sets(b.column("text").to_pylist(), words)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                keys, packed = signatures(minima([sets[i] for i in full]))
                for row, i in enumerate(full):
                    bands[i], bits[i] = keys[row], packed[row]
            longs = pa.list_(pa.int64())
            cols = [
                b.column("key"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_digest(s) for s in sets], pa.binary()), pa.array(bands, longs), pa.array(bits, longs),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "n_shingles", "digest", "bands", "bits"])

    return _keyed(docs, id_col, text_col).select("key", "doc_id", "text").mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, *, words: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, shingles) of the wanted (digest, key)."""

    def run(batches):
        for b in common.light(batches):
            sets = shingle_sets(b.column("text").to_pylist(), words)
            same = [i for i, (s, d) in enumerate(zip(sets, b.column("digest").to_pylist())) if set_digest(s) == d]
            cols = [b.column("digest").take(pa.array(same, pa.int64())), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["digest", "shingles"])

    rows = _keyed(docs, id_col, text_col).select("key", "text").join(wanted, "key").select("digest", "text")
    return rows.mapInArrow(run, "digest binary, shingles array<long>").dropDuplicates(["digest"])


def _alike(percent: int, a: str = "a", b: str = "b"):
    """Condition on two classes: sizes and packed signatures allow the wanted similarity."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = sum(
        (F.bit_count(F.expr(f"({a}.bits[{w}] ^ {b}.bits[{w}]) | ({a}.bits[{w + 2}] ^ {b}.bits[{w + 2}])")) for w in range(SLOTS // 64)),
        F.lit(0),
    )
    chance = 2.0**-BITS
    estimate = ((SLOTS - differ) / F.lit(float(SLOTS)) - chance) / (1 - chance)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (estimate >= percent / 100 - 0.25)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("digest").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("digest").alias("v"), F.col("shingles").alias("y"))
    both = pairs.join(left, "u").join(right, "v").withColumn("shared", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("shared")
    return both.where(100 * F.col("shared") >= percent * union).select("u", "v")


def _across(buckets: DataFrame, labels: DataFrame, sets: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Links between components that meet in a bucket, found through differences from a pivot.

    The pivot of a bucket is the least class of its largest component; A(x) are the shingles that x and the pivot do not
    share.  x and y are similar iff their sets differ in at most D = (100 - p) / (100 + p) * (|x| + |y|) shingles, so A(x) and A(y)
    must share t = (|A(x)| + |A(y)| - D) / 2, and t > 0 unless both are similar to the pivot, which is a link of its own.
    With A sorted from rare to common, a pair that shares t elements has its first common one so early that t - 1 can still
    follow on both sides; the join on elements keeps only such rows.  Many slightly different copies of one text share
    only common elements, which come last, and so make no pairs.
    """
    marked = buckets.join(labels.withColumnRenamed("vertex", "digest"), "digest", "left").select(
        "cell", "digest", F.coalesce("label", "digest").alias("label")
    )
    sizes = marked.groupBy("cell", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("pivot"), F.count("*").alias("parts")).where("parts > 1")
    near = marked.join(mixed.select("cell", "pivot"), "cell").where("digest <> pivot").select("pivot", "digest", "label").distinct()
    mine, theirs = sets.select("digest", F.col("shingles").alias("x")), sets.select(F.col("digest").alias("pivot"), F.col("shingles").alias("c"))
    share = (100 - percent) / (100 + percent)
    away = near.join(mine, "digest").join(theirs, "pivot").select(
        "pivot", "digest", "label", F.size("x").alias("n"), F.size("c").alias("nc"),
        F.concat(F.array_except("x", "c"), F.array_except("c", "x")).alias("apart"),
    )
    away = away.withColumn("a", F.size("apart"))
    shared = (F.col("n") + F.col("nc") - F.col("a")) / 2
    away = common.written(away.withColumn("linked", 100 * shared >= percent * (shared + F.col("a"))))
    direct = away.where("linked").select(F.col("digest").alias("u"), F.col("pivot").alias("v"))

    least = away.groupBy("pivot").agg(F.min("a").alias("any"), F.min(F.when(~F.col("linked"), F.col("a"))).alias("far")).where("far is not null")
    least = common.written(least)  # small: joined without dealing the rows of a hot pivot to one task
    widest = share * F.col("n") * (1 + 100 / percent)
    other = F.when(F.col("linked"), F.col("far")).otherwise(F.col("any"))
    must = F.greatest(F.lit(1), F.ceil((F.col("a") + other - widest) / 2 - 1e-9))
    spread = away.join(least, "pivot").where(must <= F.col("a")).select("pivot", "digest", "label", "n", "a", must.alias("must"), F.explode("apart").alias("element"))
    often = spread.groupBy("pivot", "element").agg(F.count("*").alias("often")).where("often > 1")
    # elements that nobody shares come first in the order and join with nothing: only their number counts
    common_ones = spread.join(often, ["pivot", "element"])
    order = Window.partitionBy("pivot", "digest").orderBy(F.desc("often"), F.desc("element"))
    placed = common_ones.withColumn("follow", F.row_number().over(order) - 1).where(F.col("follow") >= F.col("must") - 1)
    placed = placed.join(light.select("digest", "bits", "n_shingles"), "digest")
    x, y = placed.alias("a"), placed.alias("b")
    differ = share * (F.col("a.n") + F.col("b.n"))
    shared_least = (F.col("a.a") + F.col("b.a") - differ) / 2 - 1e-9
    pairs = x.join(
        y,
        (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.digest") < F.col("b.digest"))
        & (F.col("a.label") != F.col("b.label")) & (1 + F.least("a.follow", "b.follow") >= shared_least) & _alike(percent),
    )
    pairs = pairs.select(F.col("a.digest").alias("u"), F.col("b.digest").alias("v")).distinct()
    return direct.unionByName(_confirmed(pairs, sets, percent)).distinct()


def _grouped(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, n_shingles, n_links, root) of every document; root is the least key of its component."""
    all_docs = common.written(sketches(docs, words=words, id_col=id_col, text_col=text_col))
    some = all_docs.where("n_shingles > 0")
    first = some.groupBy("digest").agg(F.min(F.struct("key", "n_shingles", "bands", "bits")).alias("c"))
    classes = common.written(first.select("digest", "c.*"))

    cells = classes.select("digest", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("digest").alias("centre")).where("n > 1").select("cell", "centre")
    buckets = common.written(cells.join(shared, "cell"))
    wanted = classes.join(buckets.select("digest").distinct(), "digest", "left_semi")
    sets = common.written(full_sets(docs, wanted.select("digest", "key"), words=words, id_col=id_col, text_col=text_col))

    light = classes.select("digest", "n_shingles", "bits")
    star = buckets.where("digest <> centre").select(F.col("digest").alias("u"), F.col("centre").alias("v")).distinct()
    star = star.join(light.alias("a"), F.col("u") == F.col("a.digest")).join(light.alias("b"), (F.col("v") == F.col("b.digest")) & _alike(percent))
    links = common.written(_confirmed(star.select("u", "v"), sets, percent))
    labels = components(links)

    more = common.written(_across(buckets, labels, sets, light, percent))
    links = links.unionByName(more)
    # what is linked already is one vertex now: few links are left to follow
    named = labels.withColumnRenamed("vertex", "digest")
    ends = more.join(named.select(F.col("digest").alias("u"), F.col("label").alias("lu")), "u", "left")
    ends = ends.join(named.select(F.col("digest").alias("v"), F.col("label").alias("lv")), "v", "left")
    joined = components(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")))
    joined = joined.select(F.col("vertex").alias("label"), F.col("label").alias("over"))
    touched = labels.unionByName(joined.select(F.col("label").alias("vertex"), "label").join(labels.select("vertex"), "vertex", "left_anti"))
    final = touched.join(joined, "label", "left").select(F.col("vertex").alias("digest"), F.coalesce("over", "label").alias("part"))

    degree = links.select(F.explode(F.array("u", "v")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
    members = classes.select("digest", "key").join(final, "digest", "left").join(degree, "digest", "left")
    members = members.select("digest", "key", F.coalesce("part", "digest").alias("part"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    roots = members.groupBy("part").agg(F.min("key").alias("root"))
    named = members.join(roots, "part").select("digest", "n_links", "root")
    whole = some.select("key", "doc_id", "n_shingles", "digest").join(named, "digest").drop("digest")
    alone = all_docs.where("n_shingles = 0").select("key", "doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("root"))
    return whole.unionByName(alone)


def near_duplicates(docs: DataFrame, *, percent: int = 85, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, kept) of every document.

    Documents are linked where 100 * shared >= percent * union of their shingle sets; component_id is the smallest id that
    links reach, n_links the number of confirmed comparisons of the document's class (copies are not expanded).  A text without
    words is linked with nothing.  Rows with equal ids share a component only if their texts do; rows without an id belong to
    components like others, and component_id is null only where no member has an id.
    """
    found = _grouped(docs, percent, words, id_col, text_col)
    least = F.when(~F.col("root.nameless"), F.col("root.id"))
    return found.select("doc_id", "n_shingles", least.alias("component_id"), "n_links", F.col("doc_id").eqNullSafe(least).alias("kept"))


def keep_one(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the near-duplicates of a kept document: of each component one row stays.

    That is the row with the smallest id, of equal ids the text with the smallest hash; rows without an id come after all others.  Of
    rows that repeat an id and a text one stays, but texts without words stay all.  Columns are those of `docs`.
    """
    found = _grouped(docs, percent, WORDS, id_col, text_col)
    key, again = (common.free_name(docs, c) for c in ("key", "again"))
    first = found.where(F.col("key") == F.col("root")).groupBy(F.col("key").alias(key)).agg(
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias(again)
    )
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mine = F.struct(id_.isNull().alias("nameless"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(text).alias("tag"))
    left = docs.withColumn(key, mine).join(common.written(first), key)
    twice = left.where(again).dropDuplicates([key])
    return left.where(~F.col(again)).unionByName(twice).select(*docs.columns)
