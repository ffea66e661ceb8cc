"""NumPy helpers for whole-text work inside tasks: words, rolling fingerprints, ragged gathers.

Texts of a chunk lie end to end in one byte buffer. A fingerprint of a run of values is a polynomial
over a random table, taken from prefix sums, so that every window of a chunk costs a few array steps.
Working memory is about 60 bytes per byte of a chunk; a chunk holds at least one whole text.
"""

from __future__ import annotations

import ctypes
import inspect
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (functions travel by value, globals do not stay)."""
    return sys.modules.setdefault("seqloom_worker_cache", types.ModuleType("seqloom_worker_cache")).__dict__


def release() -> None:
    """Gives freed memory back to the system: a Python worker stays when its task is done, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """The kernel of a mapInArrow, after which the worker's memory is released."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(given)
        release()

    return batches


def tidy_groups(run: Callable) -> Callable:
    """The kernel of one group or of two cogroups, likewise."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    return one if len(inspect.signature(run).parameters) == 1 else two


def is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low): base^i is high[i >> 10] * low[i & 1023] for i < n."""
    out = []
    for step, size in ((pow(base, 1024, 1 << 64), (n >> 10) + 1), (base, 1024)):
        p = np.full(size, np.uint64(step))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _lowered(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """x / base^start."""
    high, low = _powers(pow(_BASE, -1, 1 << 64), int(start.max()) + 1 if len(start) else 1)
    return x * high[start >> 10] * low[start & 1023]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    high, low = _powers(_BASE, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * np.multiply.outer(high, low).ravel()[: len(values)], out=sums[1:])
    return sums


def span_prints(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the value runs [start, end)."""
    return mix(_lowered(sums[end] - sums[start], start))


def window_prints(sums: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of ``width`` values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(_lowered(sums[width:] - sums[:n], np.arange(n)))


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 7919 + 1))
    return table[data]


class Texts:
    """The texts of a chunk: ``data`` holds their UTF-8 bytes, text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            if isinstance(column, pa.ChunkedArray):
                column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        column = column.cast(pa.large_binary())
        n = len(column)
        self.null = np.asarray(column.is_null())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        body = column.buffers()[2]
        self.data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and n else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first): byte spans of the words, and per text the number of its first word (n + 1 long)."""
        return words_of(self.data, self.offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~is_space()[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[edge] = solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return span_prints(prefix_sums(byte_values(data, seed)), start, end)


def owner(first: np.ndarray) -> np.ndarray:
    """For ``first`` as offsets, the number of the run each element lies in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... of all runs, end to end."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.arange(total) + np.repeat(shift, length)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``limit`` bytes, or a single longer text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        length = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        total = np.cumsum(length)
        at = 0
        while at < n:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def cover_counts(n: int, start: np.ndarray, length: int) -> np.ndarray:
    """Marks the positions below n that lie in [s, s + length) of any start."""
    step = np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(start + length, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0
