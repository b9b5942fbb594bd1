"""What the operators of this subpackage share: tables, cut points, batches and word hashes.

Words are runs of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Hashes are 64-bit polynomial hashes taken with numpy
over a whole chunk of documents at once, then mixed; no Python call is made
for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threshmill.shared import cut, discard, shared_dir  # noqa: F401

U = np.uint64
MASK64 = (1 << 64) - 1
#: Fixed odd multipliers of the polynomial hashes over bytes and over words.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[0x41:0x5B] += 0x20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, least: int = 16, per_partition: int = 2) -> int:
    """Of a packed shuffle: a few to each shuffle partition."""
    return max(least, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a batch between Spark and Python, where the session keeps Spark's default: texts may be long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small in the memory of executors and their Python workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Give memory that this process no longer uses back to the system: Python workers stay for later tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function of batches that releases memory at its end."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            release()

    return batches


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def group(part: pa.Table) -> pa.Table:
        try:
            return f(part)
        finally:
            release()

    return group


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.cumprod(np.concatenate((np.ones(1, U), np.full(size, base, U))), dtype=U)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each values[start:end]; equal runs of values have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values)), out=total[1:])
    inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0x8CB92BA72F3D8DD7))


def text_chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets of the rows in them) of runs of whole texts of about so many bytes; a null is empty."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for part in parts:
        part = pc.fill_null(part, "")
        if not len(part):
            continue
        wide = np.int64 if pa.types.is_large_string(part.type) else np.int32
        _, at, data = part.buffers()
        offsets = np.frombuffer(at, wide)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield row + i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row += len(part)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word, with the end)."""
    if lower:
        raw = TO_LOWER[raw]
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate((np.zeros(1, bool), inside[:-1]))[: len(raw)]
    after = np.concatenate((inside[1:], np.zeros(1, bool)))[: len(raw)]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return spans_hash(raw, starts, ends, BYTE_BASE), np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values, also of runs that cross documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return spans_hash(words, at, at + k, WORD_BASE)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Of n buckets; follows the order of the hashes."""
    return ((hashes >> U(32)) * U(n)) >> U(32)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def heavy_hitters(counted: DataFrame, share: float, least: int) -> np.ndarray:
    """Sorted hashes that at least that share of the documents has, of rows (hash, n) that tasks counted; hash 0 counts the documents.

    A task reports a hash if that share of its own documents has it; what a
    share of all documents has, a share of some task's documents has. The
    result is small whatever the input: the reported counts add up to no more
    than the hashes of all documents, so there are at most (hashes in a mean
    document) / share of them.
    """
    rows = cut(counted.groupBy("hash").agg(F.sum("n").alias("n")))
    documents = rows.where("hash = 0").agg(F.sum("n")).first()[0] or 0
    found = rows.where((F.col("hash") != 0) & (F.col("n") >= max(least, share * documents))).select("hash").collect()
    return np.sort(np.array([r.hash for r in found], np.int64).view(U))
