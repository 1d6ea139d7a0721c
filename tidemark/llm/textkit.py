"""Words, shingles and their hashes over Arrow batches, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as
a-z. UTF-8 never uses those bytes inside a character, so bytes and code points
give the same words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 1 << 20  # bytes hashed at a time
GROUP = 4 << 20  # bytes of text whose words are held at a time
BATCH_ROWS = 1000

_RANDOM = np.random.default_rng(20_240_229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(32)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _powers(_BASE, PIECE)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> _SHIFT)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    rows = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    chars = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return chars, rows.astype(np.int64)


def groups(batch: pa.RecordBatch, *columns: str, limit: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes in some text columns, one row at least."""
    offsets = sum(flat(batch.column(c))[1] for c in columns)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return to the system what a task no longer needs; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def whole_texts(spark: SparkSession) -> None:
    """Let batches of whole texts have at most BATCH_ROWS rows; both sides hold several at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces that end where a word may not continue."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + PIECE, end)
        while to < end:
            space = np.flatnonzero(_SPACE[data[to : to + 4096]])
            rows = offsets[np.searchsorted(offsets, to)]
            found = to + int(space[0]) if len(space) else end
            if found <= to + 4096 or rows <= to + 4096:
                to = min(found, int(rows))
                break
            to = min(to + 4096, end)
        yield at, to
        at = to


def places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of one text start and end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the first word of each row (one more than rows)."""
    begun, hashed = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for at, to in _cuts(data, offsets):
        part = data[at:to]
        inside = ~_SPACE[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        start[edges] = inside[edges]
        starts = np.flatnonzero(start)
        if not len(starts):
            continue
        stop = ~inside
        stop[edges[edges > 0]] = True
        # a word ends at the next space, row or piece border
        borders = np.append(np.flatnonzero(stop), len(part))
        ends = borders[np.searchsorted(borders, starts, side="right")]
        n = len(part)
        power, inverse = (
            (_POWER[:n], _INVERSE)
            if n <= PIECE
            else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        )
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * power, out=sums[1:])
        begun.append(starts + at)
        hashed.append(mix((sums[ends] - sums[starts]) * inverse[starts]))
    places = np.concatenate(begun)
    return np.concatenate(hashed), np.searchsorted(places, offsets)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-word shingles of each row in order, and the first shingle of each row.

    A row of fewer words, but at least one, has its whole sequence as its one shingle.
    """
    sizes = np.diff(first)
    n = len(words)
    every = np.zeros(n, np.uint64)
    for j in range(k):
        every[: n - j] += words[j:] * _MULTIPLIERS[j]
    every = mix(every + np.uint64(k))
    counts = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    keep = np.ones(n, bool)
    ends = first[1:]
    for j in range(1, k):  # the last k-1 places of a row start no shingle
        keep[np.maximum(ends - j, first[:-1])[sizes >= j]] = False
    for row in np.flatnonzero((sizes > 0) & (sizes < k)):
        a, b = first[row], first[row + 1]
        short = (words[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64)
        every[a] = mix(np.array([short + np.uint64(b - a)], np.uint64))[0]
        keep[a] = True
    return every[keep], np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, offsets = flat(column)
    every, first = shingles(*word_hashes(data, offsets), k)
    return [np.unique(every[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
