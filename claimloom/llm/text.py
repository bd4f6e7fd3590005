"""Vectorised views of Arrow text columns: bytes, words, word hashes, shingle sets.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``. All hashes are
64-bit with fixed seeds, so reruns and retried tasks agree.
"""

from __future__ import annotations

import bisect
import ctypes
import gc
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
PIECE = 1 << 20
_POWERS = np.ones(1, U64)
#: Spark's limit, in bytes, of the Arrow batches between executors and workers; by default there is one of 10,000 rows alone.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, elementwise."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and ``n + 1`` offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.concatenate([[U64(1)], np.multiply.accumulate(np.full(size - 1, _STEP))])
    return _POWERS


def _hash_piece(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    letters = data[~SPACE[data]]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[letters] * _powers(int(lengths.max()))[place], first) + lengths.astype(U64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length in bytes of each word, and for each document its first word's index (n + 1 values)."""
    inside = ~SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    stop = np.empty(len(data), bool)
    if len(data):
        stop[:-1] = inside[:-1] & (~inside[1:] | begin[1:])
        stop[-1] = inside[-1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word and each document's first word's index; temporaries stay near ``PIECE`` bytes."""
    starts, lengths, firsts = words(data, offsets)
    out = np.empty(len(starts), U64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(starts, starts[k] + PIECE)))
        a, b = starts[k], starts[stop - 1] + lengths[stop - 1]
        out[k:stop] = _hash_piece(data[a:b], starts[k:stop], lengths[k:stop])
        k = stop
    return out, firsts


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words within one document's hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * U64(0xD1B54A32D192ED03) + hashes[k : k + n]
    return mix(out + U64(size))


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter document is one shingle of all its words, no words give none."""
    if not len(hashes):
        return np.zeros(0, U64)
    return np.unique(grams(hashes, min(size, len(hashes))))


class Taken:
    """Whether a stretch meets any of the given ``(kind, start, end)`` spans, by one bisection: among those that begin before its end, does the farthest end lie behind its start?"""

    def __init__(self, spans: list[tuple[str, int, int]]):
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))

    def __call__(self, a: int, b: int) -> bool:
        before = bisect.bisect_left(self.starts, b)
        return before > 0 and self.ends[before - 1] > a


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 * PIECE):
    """The batch in runs of rows whose texts have at most ``limit`` bytes together, or of one row."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def small_batches(spark: SparkSession) -> None:
    """From now on the session's workers get batches of some ``2 * PIECE`` bytes, or what it was given before.

    Else 10,000 texts are one batch, however long, which an executor and its worker both hold.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, str(2 * PIECE))


_WARM: dict = {}


def give_back() -> None:
    """Return freed memory to the system: a worker lives through many stages, beside others on its machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go() -> None:
    """Drop the model that this worker holds, if any, and return what it and the tasks before have freed."""
    _WARM.clear()
    give_back()


def warm(key, make: Callable):
    """What ``make`` returns, kept for later tasks of this worker; a worker holds one such model at a time."""
    if key not in _WARM:
        let_go()
        _WARM[key] = make()
    return _WARM[key]
