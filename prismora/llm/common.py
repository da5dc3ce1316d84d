"""What the operators of this package share: settings, cut tables, tokens and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that a mapper lets gather before it passes them on.
FLUSH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches between the JVM and Python, since a row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which the Python worker, which Spark keeps for later tasks, releases its memory."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Has the session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Has Spark make a filter of the ids on a join's smaller side, so that other texts aren't shuffled; it leaves the filter out where the ids are too many for it.
FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "8MB", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or, where it is unset, a new temporary folder that is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="prismora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps start from the files, which outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blobs(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text or binary column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Odd multiplier of the rolling combination of word hashes (2^64 over the golden ratio).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case: bytes.lower and bytes.split know just those."""
    return text.lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; hashing anew is faster than a dictionary of a large vocabulary."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for short arrays much faster than np.unique."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence where it is shorter; none for no words."""
    if not len(hashes):
        return hashes
    n, out = min(n, len(hashes)), None
    for k in range(n):
        part = hashes[k : len(hashes) - n + 1 + k]
        out = part.copy() if out is None else out * MULTIPLIER + part
    return mix(out + np.uint64(n))
