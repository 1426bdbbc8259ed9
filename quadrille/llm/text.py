"""Vectorised word kernels over Arrow string columns.

All work on the UTF-8 bytes of many documents at once, so no Python object is made per
word. Words are maximal runs of bytes other than the ASCII white space 0x20, 0x09-0x0D,
which on UTF-8 equals the pattern ``[^\\x20\\x09-\\x0D]+`` on characters. A null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one slice holds, unless a single document is longer.
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_IS_WORD = np.ones(256, np.bool_)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Slice(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a column; offsets are into data."""

    first: int
    offsets: np.ndarray
    data: np.ndarray


class Words(NamedTuple):
    """Byte spans and hashes of the words; words of row i are bounds[i]:bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, m in (("up", _MULT), ("down", _INV)):
                a = np.full(size, m, U64)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=U64))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield Slice(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


def words(s: Slice, lower: bool = False, hashed: bool = True) -> Words:
    """Find and hash the words of a slice; ``lower`` folds A-Z first."""
    data, n = (LOWER[s.data] if lower else s.data), len(s.data)
    inside = _IS_WORD[data]
    cuts = s.offsets[:-1][s.offsets[:-1] < n]
    before = np.empty(n, np.bool_)
    before[:1], before[1:] = False, inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, np.bool_)
    after[-1:], after[:-1] = False, inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, s.offsets)
    hashes = spans_hash(data, starts, ends) if hashed else np.empty(0, U64)
    return Words(starts, ends, bounds, hashes)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, which depends on the bytes alone."""
    up, down = _Powers.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of n consecutive word hashes; empty if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    total = np.zeros(m, U64)
    for k in range(n):
        total += mix(hashes[k : k + m] + U64(seed * 64 + k)) * U64(2 * k + 1)
    return mix(total)


def rolling(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """As shingles(), at a cost that does not depend on n."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    up, down = _Powers.of(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(mix(hashes + U64(seed)) * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * down[:m])
