"""Binary token-id store: raw id payloads in shard files, found through a minimal perfect hash index.

A shard file holds a range of documents in ascending id order:

    magic "BLID0001", then eight little-endian uint64: documents, ids, bytes per id, and the five section lengths in bytes
    levels       bit arrays of the minimal perfect hash, each preceded by its length in bits (uint64)
    fingerprints uint32 per slot
    places       (first id, number of ids) per slot, two uint64
    keys         int64 per document in file order, for listing
    payload      the ids, uint16 where the vocabulary allows it, else uint32

A key is hashed to a position in the first level; a position that several keys share stays clear and those keys go to the
next level.  The rank of a key's set bit is its slot, so n keys have the slots 0 to n-1.  The fingerprint tells keys apart
that were never stored.  A lookup reads a few words of the index and one slice of the payload, whatever the shard holds.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import common, token_ids

MAGIC = b"BLID0001"
HEAD = "<8s8Q"
HEAD_SIZE = struct.calcsize(HEAD)
NULL_KEY = -(1 << 63)  # a null id is stored under the smallest long
MANIFEST = "shard int, file string, documents long, ids long, first_key long, last_key long"


def key_hash(keys: np.ndarray, turn: np.ndarray | int = 0) -> np.ndarray:
    """64-bit hash of a key; `turn` numbers the rows that share a key."""
    with np.errstate(over="ignore"):
        return common.mix(keys.astype(np.int64).view(np.uint64) * common.BASE + np.asarray(turn, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class PerfectHash:
    """Levels of bits; `slots` gives each stored key its own number below the number of keys."""

    SPREAD = 1.6

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = []
        total = 0
        for bits in levels:
            below = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(total + below - bits)
            total += int(below[-1]) if len(below) else 0
        self.size = total

    @staticmethod
    def _at(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (common.mix(hashes + np.uint64((level + 1) * int(common.BASE) % (1 << 64))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def of(cls, hashes: np.ndarray) -> PerfectHash:
        """From distinct hashes."""
        levels: list[np.ndarray] = []
        left = hashes
        while len(left):
            bits = max(8, int(cls.SPREAD * len(left)))
            at = cls._at(left, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level has its bit."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for i, bits in enumerate(self.levels):
            at = self._at(hashes[open_], i, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(raw):
            (bits,) = struct.unpack_from("<Q", raw, at)
            n = -(-bits // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, n, at + 8))[:bits])
            at += 8 + n
        return cls(levels)


def turns(keys: np.ndarray) -> np.ndarray:
    """0, 1, ... within runs of equal keys (keys are sorted)."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    return np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))


def build_index(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(levels, fingerprints, places) of sorted keys with so many ids each."""
    hashes = key_hash(keys, turns(keys))
    found = PerfectHash.of(hashes)
    slots = found.slots(hashes)
    prints = np.empty(len(keys), "<u4")
    prints[slots] = (common.mix(hashes ^ common.BASE) >> np.uint64(32)).astype(np.uint32)
    places = np.empty((len(keys), 2), "<u8")
    places[slots, 0] = np.cumsum(counts) - counts
    places[slots, 1] = counts
    return found.dump(), prints.tobytes(), places.tobytes()


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, path: str) -> None:
        fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        self.file = fs.open_input_file(name)
        magic, self.documents, self.ids, self.width, *self.parts = struct.unpack(HEAD, self.file.read_at(HEAD_SIZE, 0))
        if magic != MAGIC:
            raise ValueError(f"no id shard: {path}")
        self.at = [HEAD_SIZE, *(HEAD_SIZE + x for x in itertools.accumulate(self.parts))]
        self.hash = PerfectHash.load(self._part(0))
        self.prints = np.frombuffer(self._part(1), "<u4")
        self.places = np.frombuffer(self._part(2), "<u8").reshape(-1, 2)

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _part(self, i: int) -> bytes:
        return self.file.read_at(self.parts[i], self.at[i])

    def keys(self) -> np.ndarray:
        return np.frombuffer(self._part(3), "<i8")

    def find(self, keys: np.ndarray, turn: np.ndarray | int = 0) -> np.ndarray:
        """(first id, number of ids) of each key; (-1, 0) for a key that is not stored."""
        hashes = key_hash(keys, turn)
        slots = self.hash.slots(hashes)
        out = np.full((len(keys), 2), (-1, 0), np.int64)
        if self.documents:
            same = (slots >= 0) & (self.prints[slots] == (common.mix(hashes ^ common.BASE) >> np.uint64(32)).astype(np.uint32))
            out[same] = self.places[slots[same]].astype(np.int64)
        return out

    def read(self, first: int, count: int) -> np.ndarray:
        raw = self.file.read_at(count * self.width, self.at[4] + first * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, key: int, turn: int = 0) -> np.ndarray | None:
        (first, count), *_ = self.find(np.array([key]), turn)
        return None if first < 0 else self.read(int(first), int(count))


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` with the scheme that the cluster gives to paths without one, so that tasks write where Spark would."""
    if "://" in folder:
        return folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return ("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri).rstrip("/")


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, *, end_id: int = 2, vocabulary: int = 1 << 16, shard_docs: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents and return the manifest (one row per shard), itself written and read again.

    Documents are range-partitioned by id and sorted, so shard after shard holds them in ascending order; null ids come
    first, equal ids follow one another by text.  Each attempt of a task writes a file of its own name and the manifest names
    the file of the attempt that counted, so a lost executor leaves an unused file at most.  `folder` is shared by all
    executors; without one it is made under spark.checkpoint.dir.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or common.shared_folder(spark)
    base = qualified(spark, folder)
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    shards = common.blocks_for(docs.count(), shard_docs)

    def run(batches):
        keys, counts, payload = [], [], []
        for b in batches:
            keys.append(b.column("key").to_numpy())
            ids, n = token_ids.encode(b.column("text").to_pylist(), tokenizer, end_id)
            counts.append(n)
            payload.append(ids.astype(kind).tobytes())
        if not keys:
            return
        key, count = np.concatenate(keys).astype("<i8"), np.concatenate(counts)
        parts = [*build_index(key, count), key.tobytes()]
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:07d}-{uuid.uuid4().hex}.bin"
        fs, root = pa.fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(struct.pack(HEAD, MAGIC, len(key), int(count.sum()), kind.itemsize, *map(len, parts), sum(map(len, payload))))
            for part in (*parts, *payload):
                out.write(part)
        row = [[shard], [f"{base}/{name}"], [len(key)], [int(count.sum())], [int(key[0])], [int(key[-1])]]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], [c.split()[0] for c in MANIFEST.split(", ")])

    rows = common.keyed_texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_KEY)).alias("key"), "text")
    dealt = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    return common.written(dealt.mapInArrow(run, MANIFEST))


def read_all(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, each found through the index of its shard.

    `start` counts the ids of all documents before it.  The running sum is taken over the manifest alone, whose size is
    one row per shard.
    """
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("before"))

    def run(batches):
        for b in batches:
            for file, first in zip(b.column("file").to_pylist(), b.column("before").to_pylist()):
                with Shard(file) as shard:
                    keys = shard.keys()
                    found = shard.find(keys, turns(keys))
                    if (found[:, 0] < 0).any():
                        raise ValueError(f"the index of {file} misses a key that it lists")
                    crc = [zlib.crc32(shard.read(a, n).astype("<u4").tobytes()) for a, n in found.tolist()]
                ids = pa.array(keys, mask=keys == NULL_KEY)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (found[:, 0] + first, found[:, 1], np.array(crc, np.int64)))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = common.blocks_for(manifest.count(), 1)
    return shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted keys, null where a key is not stored (the first row of a key that was stored repeatedly).

    Keys are routed to shards by the first keys of the shards, one number per shard, which is all that reaches the driver.
    """
    shards = manifest.orderBy("shard").select("first_key", "file").collect()
    firsts, files = np.array([r[0] for r in shards], np.int64), [r[1] for r in shards]

    @F.pandas_udf("int")
    def route(key):
        import pandas as pd

        return pd.Series(np.maximum(0, np.searchsorted(firsts, key.fillna(NULL_KEY).to_numpy(np.int64), side="right") - 1))

    def run(batches):
        held: tuple[int, Shard] | None = None
        for b in batches:
            out = []
            for key, at in zip(b.column("doc_id").to_pylist(), b.column("_shard").to_pylist()):
                if not files:
                    out.append(None)
                    continue
                if held is None or held[0] != at:
                    if held:
                        held[1].file.close()
                    held = (at, Shard(files[at]))
                ids = held[1].get(NULL_KEY if key is None else key)
                out.append(None if ids is None else ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id")).withColumn("_shard", route("doc_id"))
    return wanted.repartition("_shard").sortWithinPartitions("_shard").mapInArrow(run, "doc_id long, ids array<int>")


def open_store(spark: SparkSession, manifest_path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest_path)
