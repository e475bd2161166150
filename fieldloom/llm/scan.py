"""Vectorised scans of UTF-8 text columns inside tasks: words, hashes and shingles with numpy.

Spark splits the table into Arrow batches; these helpers cut a batch into slices of a MB, so that memory
follows the slice (or one single text, where that is longer) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

#: White space of the contracts: space and \\t \\n \\v \\f \\r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: One fixed random 64-bit value for each byte, upper-case ASCII folded to lower case.
BYTE_VALUE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * U64(2) + U64(1)
#: As BYTE_VALUE, but with case kept apart.
CASED_VALUE = np.random.default_rng(20240102).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {_BASE: np.ones(1, U64), _INVERSE: np.ones(1, U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
    _powers[base] = have if len(have) <= 4 * SLICE_BYTES else have[: 4 * SLICE_BYTES].copy()
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, target: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes; a longer row makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + target, "right")) - 1)
        yield first, last
        first = last


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hashes of the byte ranges ``data[start:end]``."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(_BASE, len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, len(data))[start])


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``flat[at:at + size]``, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(at - before, size) + np.arange(int(size.sum()))]


def words(
    data: np.ndarray,
    offsets: np.ndarray,
    gap: np.ndarray = SPACE,
    values: np.ndarray = BYTE_VALUE,
    parting: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first byte, byte after the last) of each word: a run of bytes outside ``gap``.

    Words end with their row, and between a byte of the first and a byte of the second set of ``parting``.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] |= inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] |= inside[edge - 1]
    if parting:
        cut = np.flatnonzero(parting[0][data[:-1]] & parting[1][data[1:]])
        ends[cut] = True
        begins[cut + 1] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, hashes(data, start, end, values), start, end


def shingles(row: np.ndarray, word: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``size`` words within a row.

    With ``short``, a row with fewer words gives its whole sequence as one shingle.
    """
    n = len(row)
    factor = [U64(pow(_BASE, 2 * j + 3, 2**64)) for j in range(size)]
    parts, firsts = [], []
    if n >= size:
        full = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])
        value = np.zeros(len(full), U64)
        for j in range(size):
            value += word[full + j] * factor[j]
        firsts.append(full)
        parts.append(mix(value + U64(size)))
    if short and n:
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        count = np.diff(np.r_[first, n])
        first, count = first[count < size], count[count < size]
        value = count.astype(U64)
        for j in range(size - 1):
            has = count > j
            value[has] += word[first[has] + j] * factor[j]
        firsts.append(first)
        parts.append(mix(value))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first, value = np.concatenate(firsts), np.concatenate(parts)
    order = np.argsort(first, kind="stable")
    return first[order], value[order]


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``taken`` has them (case doesn't tell columns apart)."""
    lower, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value) pairs, ordered by row and value."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        keep = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
        row, value = row[keep], value[keep]
    return row, value
