"""Vectorised byte kernels over Arrow batches: words, word hashes and windows of words.

Texts arrive as UTF-8 bytes.  A batch is cut into blocks of about a quarter of a megabyte at document ends, so
temporary arrays stay bounded whatever the batch; a longer document makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything but digits, ASCII letters and bytes of non-ASCII characters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_tables: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.extend((_powers(_P, BLOCK_BYTES + 1), _powers(_P_INVERSE, BLOCK_BYTES + 1)))
    return _tables[0], _tables[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def column_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary or string column as one byte array and ``rows + 1`` offsets; nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole documents."""
    data, bounds = column_bytes(batch, name)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        end = int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end
    pa.default_memory_pool().release_unused()  # a worker goes on to other tasks; what this batch took goes back


def words(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes, and each document's first word (+ the total)."""
    inside = ~separator[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _polynomial(data: np.ndarray) -> int:
    """The polynomial of one long word, a block at a time."""
    power, _ = _power_tables()
    total, scale = 0, 1
    for at in range(0, len(data), BLOCK_BYTES):
        part = data[at : at + BLOCK_BYTES]
        value = int(((part.astype(U64) + U64(1)) * power[: len(part)]).sum(dtype=U64))
        total = (total + value * scale) % (1 << 64)
        scale = scale * pow(_P, len(part), 1 << 64) % (1 << 64)
    return total


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words; equal words have equal hashes in every process."""
    power, inverse = _power_tables()
    out = np.empty(len(starts), dtype=U64)
    i, n = 0, len(starts)
    while i < n:
        origin = starts[i]
        j = int(np.searchsorted(ends, origin + BLOCK_BYTES, side="right"))
        if j <= i:
            out[i] = U64(_polynomial(data[origin : ends[i]]))
            i += 1
            continue
        part = data[origin : ends[j - 1]]
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=sums[1:])
        a, b = starts[i:j] - origin, ends[i:j] - origin
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, by first word; runs may cross documents."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for k in range(size):
        out = out * U64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
        out ^= out >> U64(29)
    return mix(out)
