"""Whole-batch tokenising and 64-bit word hashing of Arrow string columns with numpy.

Words are maximal runs of bytes that are not in [\\x20\\x09-\\x0D]; A-Z can be folded. All work is on the Arrow
buffers of a batch: no Python object is made per word. Equal words have equal hashes; two different words share
a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at a time; bounds the memory of a Python worker whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20
_SHORT = 48
_PRIME = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(*columns: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text each; a longer text makes a range of its own."""
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(c), 0), dtype=np.int64) for c in columns)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets, from 0; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in text order, number of words of each row)."""
    data, offsets = raw(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    if fold:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(first, offsets))
    return _hash(data, first, last - first), counts


def _hash(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    key = np.minimum(length, _SHORT + 1).astype(np.uint8)
    order = np.argsort(~key, kind="stable")  # longest first; one byte a key, so a counting sort
    at, sizes = first[order], length[order]
    per_size = np.bincount(key, minlength=_SHORT + 2)
    longer = int(per_size[_SHORT + 1])
    at_least = per_size[::-1].cumsum()[::-1]
    state = _SEED ^ sizes.astype(np.uint64)
    out = np.empty(len(first), dtype=np.uint64)
    for k in range(_SHORT):
        live = int(at_least[k + 1])
        if live <= longer:
            break
        part = state[longer:live]
        part ^= data[at[longer:live] + k]
        part *= _PRIME
    view = data.tobytes() if longer else b""
    for i in range(longer):
        state[i] = xxhash.xxh3_64_intdigest(view[at[i] : at[i] + sizes[i]])
    out[order] = state
    return mix(out)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """The row number of every word."""
    return np.repeat(np.arange(len(counts)), counts)
