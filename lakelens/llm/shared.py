"""What the operators of this subpackage share: column picking, scratch tables, byte-level word scans."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by position of the first exact match, so extra or clashing columns never matter."""
    columns = df.columns
    return numbered(df).select(*[F.col(f"c{columns.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> DataFrame:
    """All columns under names c0, c1, .., so that names that clash, in letter case or with ours, never matter."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only in a single-machine session that names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakelens-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write go at once; they are never read again.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, codec: str = "lz4_raw") -> DataFrame:
    """Cuts lineage: written to the shared folder and reread, so lost executors cost no recomputation."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, label: str, codec: str = "lz4_raw") -> DataFrame:
    """A table that outlives the call: results that are read later."""
    return write(df, scratch(df.sparkSession, label), codec)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables and broadcasts of one run, all gone when it ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.dir, self.count, self.sent = spark, scratch(spark, label), 0, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        drop_path(self.spark, self.dir)
        for b in self.sent:
            b.destroy()

    def keep(self, df: DataFrame, label: str, codec: str = "lz4_raw") -> DataFrame:
        self.count += 1
        return write(df, f"{self.dir}/{label}-{self.count}", codec)

    def send(self, value: object) -> Broadcast:
        """For values of a bounded size only."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function of batches, which gives unused memory back when a task ends: Python workers live on and serve other tasks."""

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not with this C library
            pass

    return whole


# ---------------------------------------------------------------- Arrow text columns


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without Python strings; null is empty."""
    n, (_, at, body) = len(column), column.buffers()
    if n == 0 or at is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(at, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `most` bytes of text; a longer text comes alone, whole."""
    _, offsets = utf8(batch.column(column))
    n, at = batch.num_rows, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# ---------------------------------------------------------------- words

#: Bytes of words that run to the next ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII digits, letters and everything beyond ASCII (capitals are lowered first).
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(low: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's range in them (offsets in words)."""
    mask = inside[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True  # a word never crosses documents
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | first[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.empty(n, U64)
            out[0] = 1
            done, step = 1, base
            while done < n:  # doubling
                m = min(done, n - done)
                out[done : done + m] = out[:m] * U64(step)
                done, step = done + m, (step * step) & (2**64 - 1)
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Prefix:
    """Hashes of any substrings of a buffer from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of every word, in pieces of bounded memory."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        a = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, a + most, side="right")))
        p = Prefix(low[a : ends[end - 1]])
        out[at:end] = p.hashes(starts[at:end] - a, ends[at:end] - a)
        at = end
    return out


_SPREAD = [U64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64)]


def gram_hashes(words: np.ndarray, k: int, places: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of every run of k word hashes, in order, or of those at the given places."""
    n = len(words) - k + 1 if places is None else len(places)
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0x9FB21C651E98DF25) + (words[i : i + n] if places is None else words[places + i]) * _SPREAD[i]
    return mix(out ^ U64(k))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(s, s + n) of all pairs."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
