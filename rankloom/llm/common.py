"""Helpers shared by the training-data operators: scratch tables and word scanning over Arrow buffers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rankloom.session import reachable

U64 = np.uint64
#: Separators: the space and the bytes 0x09 to 0x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BLOCK_MASK = np.array([0, *((1 << (8 * i)) - 1 for i in range(1, 9))], dtype=U64)
#: Longer words are hashed one by one.
_LONG_WORD = 2048
#: Bytes of text that one NumPy pass works on; it bounds the memory of a Python worker unless one text is longer.
CHUNK_BYTES = 3 << 20


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there, so a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    reachable(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def save_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, str, dict[str, int]]:
    """``save``, with the number of rows (``rows``) and of those that meet each condition, taken while writing."""
    seen = Observation()
    saved, path = save(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), name)
    return saved, path, seen.get


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts as byte buffers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges whose texts have about ``most`` bytes together, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of all texts, and the index of each text's first word (one more entry than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SEPARATOR[buf]
    inner = offs[(offs > 0) & (offs < len(buf))]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[inner] = word[inner]
    end = word.copy()
    end[:-1] &= ~word[1:]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, in place on a uint64 array."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, both: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """One or two independent 64-bit hashes of each span, from eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    length = e - s
    h1 = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    h2 = mix(length.astype(U64) * U64(0xD1342543DE82EF95) + U64(0x2545F4914F6CDD1D)) if both else None
    block = blocks[s] & _BLOCK_MASK[np.minimum(length, 8)]
    h1 = mix(h1 ^ block)
    if both:
        h2 = mix(h2 + block * U64(0xDA942042E4DD58B5))
    live, k = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(live):
        block = blocks[s[live] + k] & _BLOCK_MASK[np.minimum(length[live] - k, 8)]
        h1[live] = mix((h1[live] * U64(0x9FB21C651E98DF25)) ^ block)
        if both:
            h2[live] = mix(h2[live] * U64(0xC2B2AE3D27D4EB4F) + block * U64(0xDA942042E4DD58B5))
        k += 8
        live = live[length[live] > k]
    for i in np.flatnonzero(length > _LONG_WORD):
        digest = hashlib.blake2b(buf[s[i] : e[i]].tobytes(), digest_size=16).digest()
        h1[i] = int.from_bytes(digest[:8], "little")
        if both:
            h2[i] = int.from_bytes(digest[8:], "little")
    return h1, h2


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes (``len(h) - width + 1`` of them)."""
    n = len(h)
    if n < width:
        return np.zeros(0, U64)
    up = powers(base, n)
    total = np.zeros(n + 1, U64)
    np.cumsum(h * up, out=total[1:])
    down = powers(pow(base, -1, 1 << 64), n - width + 1)
    return mix((total[width:] - total[:-width]) * down)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given lengths laid end to end: the row of each element, and its place in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return row, np.arange(len(row)) - first[row]


def gather_spans(buf: np.ndarray, s: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of spans (``s``, ``length``) laid end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, buf.dtype)
    first = np.cumsum(length) - length
    return buf[np.repeat(s - first, length) + np.arange(total)]


def binary(parts: list[bytes | memoryview]) -> pa.Array:
    return pa.array(parts, pa.binary())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
