"""Vectorised helpers on Arrow text columns, used inside Spark tasks.

Texts of a batch are seen as one byte buffer plus row offsets, so hashing, word splitting and counting are numpy passes
over bytes. Nothing here knows Spark except ``map_batches``, which adapts a function of record batches to ``mapInArrow``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text handled by one numpy pass; bounds the memory of a Python worker. A longer text is a pass of its own.
CHUNK_BYTES = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, CHUNK_BYTES + 1), b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


class RollingHash:
    """64-bit polynomial hashes of any stretches of a sequence of bytes or 64-bit values, from prefix sums; ``which`` picks one of two families."""

    def __init__(self, buf: np.ndarray, which: int = 0):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        terms = _TABLES[which][buf] if buf.dtype == np.uint8 else mix(buf + _TABLES[which][0])
        np.cumsum(terms * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position on."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def utf8(column: pa.Array | pa.ChunkedArray, as_is: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column, null being an empty text; ``as_is``: of large binary values without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not as_is:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with at most ``limit`` bytes each, but one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``; no word spans two rows."""
    return runs(~_SPACE[buf], off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of sorted stretches, some CHUNK_BYTES of the buffer at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK_BYTES)))
        out[i:j] = RollingHash(buf[start[i] : end[j - 1]])(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of true positions, cut at row borders."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return start, end, np.searchsorted(off, start, side="right") - 1


def windows(values: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive values of the same row, and the index of the first of each."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9DDFEA08EB382D69) + values[k : k + n]
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    return mix(h[at]), at


def batch(columns: dict[str, pa.Array | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=schema.field(k).type) for k, x in columns.items()], schema=schema)


def grouped(batches, names: list[str], limit: int, size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """Whole groups of the rows, sorted by ``names``, gathered to at least ``limit`` by ``size`` of a row."""
    kept, amount, open_key = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(x)).to_numpy() for x in names])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        weights = np.concatenate([[0], np.cumsum(size(b))])
        begin = 0
        for x in [0, *change.tolist()]:
            key = tuple(keys[:, x])
            if key != open_key and amount + weights[x] - weights[begin] >= limit:
                if x > begin:
                    kept.append(b.slice(begin, x - begin))
                if kept:
                    yield pa.Table.from_batches(kept)
                kept, amount, begin = [], 0, x
            open_key = key
        if begin < b.num_rows:
            kept.append(b.slice(begin))
            amount += weights[-1] - weights[begin]
    if kept:
        yield pa.Table.from_batches(kept)


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay for a minute and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``, releasing its memory at the end of a task."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from f(b)

    return df.mapInArrow(tidy(run), schema)
