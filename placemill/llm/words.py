"""Vectorised words of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Everything works on the UTF-8
buffers of an Arrow string column, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once (one document may be longer); a worker needs some thirty times as much memory.
SLICE_BYTES = 500_000

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x) | np.uint64(1)


#: Masks of the first 0 to 8 bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@dataclass
class Words:
    """Words of the texts of a slice: word k has bytes start[k]:end[k] of data and belongs to row[k] (from 0 in the slice)."""

    first: int  # row of the batch where the slice begins
    rows: int
    data: np.ndarray
    offsets: np.ndarray  # of texts in data; rows + 1
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    bounds: np.ndarray  # of words by row; rows + 1

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        # eight bytes at a time: each group is mixed with its place, and their sum with the length
        lengths = self.end - self.start
        groups = (lengths + 7) >> 3
        firsts = np.cumsum(groups) - groups
        place = np.arange(int(groups.sum())) - np.repeat(firsts, groups)
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=np.append(self.data, np.zeros(8, dtype=np.uint8)), strides=(1,))
        part = eight[np.repeat(self.start, groups) + 8 * place]
        part &= _FIRST[np.minimum(np.repeat(lengths, groups) - 8 * place, 8)]
        part += (place + 1 + seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sums = np.add.reduceat(mix(part), firsts)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, hashes: np.ndarray, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words and whether each starts inside one text (same length as hashes)."""
        n = len(hashes)
        out = np.zeros(n, dtype=np.uint64)
        whole = np.zeros(n, dtype=bool)
        if n >= size:
            m = table(size, seed)
            last = n - size + 1
            acc = np.zeros(last, dtype=np.uint64)
            for j in range(size):
                acc += hashes[j : j + last] * m[j]
            out[:last] = mix(acc)
            whole[:last] = self.row[:last] == self.row[size - 1 :]
        return out, whole


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of rows) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        return text_buffers(column.cast(pa.large_string()))
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SLICE_BYTES, blank: np.ndarray = _WS) -> Iterator[Words]:
    """The words of consecutive rows, about `limit` bytes at a time; lower: A-Z become a-z first; blank: by byte, whether it stands between words."""
    raw, at = text_buffers(column)
    n, a = len(at) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        data = raw[at[a] : at[b]]
        if lower:
            data = _LOWER[data]
        offsets = at[a : b + 1] - at[a]
        word = ~blank[data]
        if len(word):
            begin = word.copy()
            begin[1:] &= ~word[:-1]
            cut = offsets[:-1][offsets[:-1] < len(word)]
            begin[cut] = word[cut]  # a text's first byte never continues the text before
            stop = word.copy()
            stop[:-1] &= ~word[1:] | begin[1:]
            start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            start = end = np.zeros(0, dtype=np.int64)
        row = np.searchsorted(offsets, start, side="right") - 1
        # empty texts share an offset with the next one: the last such row owns the byte
        bounds = np.searchsorted(start, offsets, side="left")
        yield Words(a, b - a, data, offsets, start, end, row, bounds)
        a = b
