"""Words of many texts at once: hashing over the bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``.  Texts are taken whole; only the number of
texts that are worked on together is bounded (``SLAB`` bytes, or one text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB = 2_000_000

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By the bytes of a span that a lane holds: the mask that keeps them.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_KEY = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes, joined: the range and the place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One value of two (each a result of ``mix``); linear in neither."""
    return mix(left * _U(0xD6E8FEB86659FD93) + mix(right + _KEY))


def tree_hash(values: np.ndarray, sizes: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of each run of ``values`` (of ``sizes``, one or more, joined).

    Neighbours are joined in a tree, so that no two runs collide by their form;
    the size goes in at last.
    """
    salt = mix(np.array([key], np.uint64) + _KEY)[0]
    values, left = mix(values ^ salt), np.asarray(sizes, np.int64)
    out, at = np.zeros(len(left), np.uint64), np.arange(len(left))
    while len(at):
        begin = np.cumsum(left) - left
        done = left == 1
        out[at[done]] = values[begin[done]]
        at, begin, left = at[~done], begin[~done], left[~done]
        owner, place = ranges((left + 1) >> 1)
        first = begin[owner] + 2 * place
        single = 2 * place + 1 == left[owner]
        second = values[first + ~single]
        values = np.where(single, values[first], join(values[first], second))
        left = (left + 1) >> 1
    return mix(out ^ mix(np.asarray(sizes).astype(np.uint64) * _KEY + salt))


def window_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A hash of each window ``values[begin:end]`` (not empty); windows may
    overlap: each is two runs of a power of two of values, whose hashes are
    made by doubling once for all places."""
    out = np.zeros(len(begin), np.uint64)
    size = end - begin
    power = np.frexp(size)[1] - 1  # of the longest run that fits
    runs = mix(values ^ mix(np.array([key], np.uint64) + _KEY))
    for k in range(int(power.max(initial=0)) + 1):
        at = np.flatnonzero(power == k)
        out[at] = join(runs[begin[at]], runs[end[at] - (1 << k)])
        runs = join(runs[: max(0, len(runs) - (1 << k))], runs[1 << k :])
    return mix(out ^ mix(size.astype(np.uint64) * _KEY))


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans as runs of 64-bit values, zeros behind the last byte, and
    the number of each span's values."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    by_byte = np.ndarray((len(data) + 1,), "<u8", held.data, strides=(1,))
    sizes = np.maximum((ends - starts + 7) >> 3, 1)
    owner, place = ranges(sizes)
    begin = starts[owner] + 8 * place
    return by_byte[begin] & _KEEP[np.minimum(ends[owner] - begin, 8)], sizes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, key: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes hash alike anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values, sizes = lanes(_LOWER[data] if fold else data, starts, ends)
    return mix(tree_hash(values, sizes, key) ^ mix((ends - starts).astype(np.uint64)))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A span of each group of equal bytes (and equal ``salt``), and each
    span's group.  Hashes make the groups and bytes confirm them: a span that
    differs from its group's first one is grouped by its bytes themselves."""
    hashes = span_hashes(data, starts, ends)
    extra = np.zeros(len(starts), np.uint64) if salt is None else salt.astype(np.uint64)
    _, first, group = np.unique(mix(hashes + _KEY * extra), return_index=True, return_inverse=True)
    values, sizes = lanes(data, starts, ends)
    begin, model = np.cumsum(sizes) - sizes, first[group]
    odd = (ends - starts != (ends - starts)[model]) | (extra != extra[model])
    owner, place = ranges(np.where(odd, 0, sizes))
    odd[owner[values[begin[owner] + place] != values[begin[model[owner]] + place]]] = True
    groups: dict[tuple[bytes, int], int] = {}
    more: list[int] = []
    for k in np.flatnonzero(odd).tolist():
        own = data[starts[k] : ends[k]].tobytes(), int(extra[k])
        if own not in groups:
            groups[own] = len(first) + len(more)
            more.append(k)
        group[k] = groups[own]
    return np.append(first, np.asarray(more, first.dtype)), group


@dataclass
class Slab:
    """Rows ``first`` to ``last`` (exclusive) of a column and their words."""

    first: int
    last: int
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of the rows in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    row: np.ndarray  # of each word, from 0

    @property
    def rows(self) -> int:
        return self.last - self.first

    def word_bounds(self) -> np.ndarray:
        """Words before each row, and in all."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self, fold: bool, key: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, fold, key)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slabs(column: pa.Array) -> Iterator[Slab]:
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLAB, "right")) - 1)
        last = min(last, n)
        yield slab(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def slab(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Slab:
    n = len(data)
    inside = ~_WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return Slab(first, first + len(offsets) - 1, data, offsets, starts, np.flatnonzero(finishes) + 1, rows)


def shingles(s: Slab, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words; a row with fewer words
    has one shingle, its whole sequence, and a row without words none."""
    bounds = s.word_bounds()
    counts = np.diff(bounds)
    if len(hashes) >= size:
        full = np.flatnonzero(s.row[: len(hashes) - size + 1] == s.row[size - 1 :])
        out = np.full(len(full), size, np.uint64)
        for k in range(size):
            out = mix(out + hashes[full + k] * _U(2 * k + 3))
        rows = s.row[full]
    else:
        out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([_sequence(hashes[bounds[r] : bounds[r + 1]]) for r in short], np.uint64)
        out, rows = np.concatenate([out, whole]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def _sequence(hashes: np.ndarray) -> np.ndarray:
    out = np.full(1, len(hashes), np.uint64)
    for k in range(len(hashes)):
        out = mix(out + hashes[k : k + 1] * _U(2 * k + 3))
    return out[0]


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, joined, and their bounds."""
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), np.int64, n_rows)
    out = np.zeros(n_rows + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value a row: its part of ``values`` as it lies in memory."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
