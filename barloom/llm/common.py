"""What the text operators share: reading texts from any table, chunking, shared folders, 64-bit mixing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled at once by the array code; bounds the memory of a Python worker.
CHUNK_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of `docs`, whatever else it holds; a null text counts as empty, a null id stays null."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def chunks(texts: list[str], limit: int = CHUNK_CHARS):
    """Index ranges (lo, hi) whose texts hold about `limit` characters; one longer text makes a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def light(batches, column: str = "text", limit: int = 4_000_000):
    """The Arrow batches in slices of about `limit` bytes of `column`, so that no more is held as Python values at once."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that `df` does not have yet."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir.

    A temporary folder stands in only where none is named and driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: lost executors re-read files, not the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n; kept between calls."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of mix(code) * B**j over j < i, so that any slice has a hash in constant time."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed_codes(codes) * up[: len(codes)], out=out[1:])
    return out


_CODE_MIX = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED270B))


def mixed_codes(codes: np.ndarray) -> np.ndarray:
    if len(codes) and int(codes.max()) >= 1 << 16:
        return np.where(codes < 1 << 16, _CODE_MIX[codes & 0xFFFF], mix(codes.astype(np.uint64) + np.uint64(0x51ED270B)))
    return _CODE_MIX[codes]


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each slice [start, end): the same for equal contents wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges start, ..., start + length - 1, one range after another."""
    lengths = np.asarray(lengths, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    steps = np.ones(int(ends[-1]), np.int64)
    steps[0] = starts[0]
    steps[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps)
