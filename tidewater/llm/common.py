"""What the operators share: shipping the package to workers, bounded samples, fast word hashes."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import components as components
from ..saved import if_small as if_small
from ..saved import saved as saved
from ..saved import shared_dir as shared_dir

#: Rows and bytes of whole texts in one Arrow batch; they bound a Python worker's memory, with long texts too.
ARROW_ROWS, ARROW_BYTES = "512", "2m"
#: Bytes of text that are worked on at once; numpy arrays of eight bytes a byte of text are made from a slice.
SLICE_BYTES = 1 << 18


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps their Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    # the plan is made when the caller runs it, so the settings stay for the session
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after whose last batch the worker gives freed memory back: it outlives its task and may wait idle."""

    @functools.wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return freed


def least_hashed(df: DataFrame, hashed: str, rows: int) -> DataFrame:
    """The `rows` rows of a saved table whose 64-bit hash column is least, at most.

    A bound on the hash, from the number of rows, leaves little more than that for the last cut, however many
    partitions there are. Which rows these are doesn't depend on partitioning but for ties.
    """
    share = min(1.0, 1.1 * rows / max(1, df.count()))
    return df.filter(F.col(hashed) <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy(hashed).limit(rows)


# ---- words and their hashes -------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
#: Two independent tables of random 64-bit values for bytes; the folded one maps A-Z to a-z.
_TABLES = _RNG.integers(0, 2**64, size=(2, 256), dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, size=(2, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(lane: int, n: int) -> np.ndarray:
    if len(_POWERS.get(lane, ())) < n:
        table = np.full(max(n, 256), _ODD[lane, 0], np.uint64)
        table[0] = 1
        _POWERS[lane] = np.multiply.accumulate(table)
    return _POWERS[lane]


def chunks(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about `most` bytes: first row, last row, bytes, row offsets into them.

    Null rows come out as rows of no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words `[^\\x20\\x09-\\x0D]+`, and each row's first word (with the total at the end)."""
    solid = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = solid[cuts]
    ends[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0, fold: bool = False) -> np.ndarray:
    """A 64-bit hash for each word; with fold, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = _TABLES[lane][_FOLD] if fold else _TABLES[lane]
    sizes = ends - starts
    power = _powers(lane, int(sizes.max()) + 1)
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    within = np.arange(total) - np.repeat(first, sizes)
    values = table[data[within + np.repeat(starts, sizes)]] * power[within]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def windows(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _ODD[lane, 1] + hashes[j : j + n]
    return mix(out)
