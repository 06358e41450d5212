"""Word and shingle hashing shared by the document operators (numpy inside Spark tasks).

Words are the maximal runs of anything but ASCII white space, A-Z in lower case. All words of
a slice of an Arrow column are hashed at once from its bytes: with prefix sums of
byte * base^position, the hash of a word is a difference of two sums, shifted back by the
inverse power. A set of shingles is a sorted array of distinct 64-bit hashes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SHINGLE = 5
SLICE_BYTES = 1 << 20   # texts are hashed in slices of about this size
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_TABLES: dict = {}


def _tables(n: int):
    if _TABLES.get("n", 0) < n:
        n = max(n, SLICE_BYTES + 4096)
        _TABLES.update(n=n, up=_powers(_BASE, n), down=_powers(pow(_BASE, -1, 1 << 64), n))
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def hash_words(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _SPACE):
    """``hashes, first``: of all words of texts that lie end to end in ``data``; text i has the words
    ``first[i]:first[i + 1]``. ``bounds``: where texts begin, and the end of the last. ``breaks``: bytes between words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~breaks[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    edges = bounds[:-1][(bounds[:-1] < n) & (bounds[:-1] < bounds[1:])]
    begins[edges] |= word[edges]
    ends[edges[1:] - 1] |= word[edges[1:] - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:n], out=sums[1:])
    hashes = (sums[stop] - sums[start]) * down[start]
    hashes = mix(hashes + (stop - start).astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(start, bounds)


def released() -> None:
    """Gives the system back what earlier batches and groups have freed; a worker process would keep it for its whole life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):   # another C library
        pass


def texts(column: pa.Array):
    """``first row, data, bounds`` of slices of a string column; null is empty, a longer text is a slice by itself."""
    released()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row]
        row = last


def hashed_texts(column: pa.Array):
    """``first row, hashes, first word of each text`` slice by slice; very long texts are hashed in parts."""
    for row, data, bounds in texts(column):
        if len(data) <= 4 * SLICE_BYTES:
            yield row, *hash_words(data, bounds)
            continue
        parts, at = [], 0
        while at < len(data):
            stop = min(len(data), at + 2 * SLICE_BYTES)
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
            parts.append(hash_words(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        hashes = np.concatenate(parts)
        yield row, hashes, np.array([0, len(hashes)])


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one shingle, no words give none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = out * _STEP + words[j:n - width + 1 + j]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """``first row, sets``: the shingle set of every text of a slice."""
    for row, hashes, first in hashed_texts(column):
        runs = shingles(hashes, size)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(distinct(runs[a:b - size + 1]) if b - a >= size else shingles(hashes[a:b], size))
        yield row, out


def set_ids(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each set, whatever the order of its members; sets lie end to end and are not empty."""
    a = np.add.reduceat(mix(values ^ np.uint64(0x51ED270B)), starts)
    b = np.add.reduceat(mix(values * np.uint64(0x2545F4914F6CDD1D)), starts)
    return a.view(np.int64), b.view(np.int64)


def joined(sets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``values, starts, lengths`` of sets laid end to end."""
    lengths = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    return values, np.cumsum(lengths) - lengths, lengths


def rows(batch: pa.RecordBatch, size: int = 512):
    """Slices of a batch, small enough that their Python objects stay small."""
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def table(columns: dict, schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in schema.items()], names=list(schema))
