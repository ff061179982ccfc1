"""Shared pieces of the text operators: Arrow chunks, word scanning, hashing, checkpoints."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

#: The temporary folder of each application in local mode.
_LOCAL: dict[str, str] = {}


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that hands its memory back to the system when it ends. Python workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(*args: object) -> Iterator:
        try:
            yield from run(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode without it, a temporary one, which lasts as long as the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
            removed_at_end(spark, _LOCAL[app])
        found = _LOCAL[app]
    return found


def removed_at_end(spark: SparkSession, folder: str) -> None:
    """Has the driver remove a folder of ours when the application ends; results are read lazily, so not before."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once below the shared folder, in a folder of this application, and read back."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
    removed_at_end(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint()


def counted(df: DataFrame, *sums: str) -> tuple[DataFrame, dict[str, int]]:
    """``checkpointed(df)``, with its rows ``n`` and how many have each of the boolean columns ``sums``, counted on the way."""
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in sums)))
    return out, seen.get


def own_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, removed when the application ends."""
    folder = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    removed_at_end(spark, folder)
    return folder


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, lists: str, most: int) -> Iterator[pa.Table]:
    """Rows that come group by group of ``key``, in tables of whole groups that hold about ``most`` values of ``lists`` (a larger group is a table of its own)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        column = batch.column(key).to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1]) if len(column) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(batch.column(lists).value_lengths().to_numpy(zero_copy_only=False))])
        for s in starts.tolist():
            if size + total[s] - total[at] < most or not (s or held and held[-1].column(key)[-1].as_py() != column[0]):
                continue
            if s > at:
                held.append(batch.slice(at, s - at))
            yield pa.Table.from_batches(held)
            held, size, at = [], 0, s
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(total[-1] - total[at])
    if held:
        yield pa.Table.from_batches(held)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One random 64-bit value for each byte, and one odd multiplier for each position of a word.
_BYTE = splitmix(np.arange(256, dtype=U64) + U64(1000))
_POSITION = splitmix(np.arange(4096, dtype=U64) + U64(1 << 40)) | U64(1)


def _positions(n: int) -> np.ndarray:
    global _POSITION
    if n > len(_POSITION):
        _POSITION = splitmix(np.arange(2 * n, dtype=U64) + U64(1 << 40)) | U64(1)
    return _POSITION


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that separate words. Both classes are ASCII sets, so scanning UTF-8 bytes finds what the code-point patterns find.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def utf8(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes in one array, A-Z in lower case, and row offsets. Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw, data = column.buffers()[1:]
    at = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1] if raw is not None and len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return (_LOWER[buf] if lower else buf), at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most ``most`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(buf: np.ndarray, at: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes that aren't separators."""
    n = len(buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~separators[buf]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    position = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    picked = buf[position + np.repeat(starts, lengths)]
    return splitmix(np.add.reduceat(_BYTE[picked] * _positions(int(lengths.max()) + 1)[position], first) + lengths.astype(U64))


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive word hashes (whole sequence if shorter)."""
    n = len(hashes)
    size = min(size, n)
    if not size:
        return np.zeros(0, U64)
    total = np.full(n - size + 1, size, U64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * _POSITION[k]
    return splitmix(total)
