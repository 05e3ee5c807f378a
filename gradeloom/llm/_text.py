"""Vectorised words, lines and n-grams over whole texts held in Arrow buffers.

A word's hash comes from prefix sums of byte codes times powers of an odd base, modulo 2**64, so no Python
object is made per word. Long texts are worked through in windows cut at separators; nothing is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
WINDOW = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240517)
_CODE = _RNG.integers(1, 2**63, 256, dtype=U)
_COEF = _RNG.integers(1, 2**63, 64, dtype=U) | U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["pow"]) < n:
        size = max(n, WINDOW * 2)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["pow"][:n], _powers["inv"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def row_blocks(column, limit: int = 4 << 20):
    """Slices (first row, last row) of about `limit` bytes, a row at least."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, s in enumerate(size):
        if total and total + s > limit:
            yield first, i
            first, total = i, 0
        total += int(s)
    if first < len(size):
        yield first, len(size)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, fold: bool = False):
    """Starts, ends and row numbers of the maximal stretches without separator bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    off = separator[_LOWER[data] if fold else data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = ~off, ~off
    start[1:] &= off[:-1] | edge[1:-1]
    end[:-1] &= off[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of sorted, disjoint spans."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
        part = data[low : int(ends[j - 1])]
        if fold:
            part = _LOWER[part]
        powers, inverse = _power(len(part) + 1)
        sums = np.empty(len(part) + 1, U)
        sums[0] = 0
        np.cumsum(_CODE[part] * powers[:-1], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) * _COEF[63])
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, fold: bool = False):
    """Hashes, row numbers, starts and ends of words."""
    starts, ends, rows = spans(data, offsets, separator, fold)
    return hash_spans(data, starts, ends, fold), rows, starts, ends


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a row, and the index of their first word."""
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = hashes[: len(hashes) - n + 1] * _COEF[0]
    for k in range(1, n):
        total = total + hashes[k : len(hashes) - n + 1 + k] * _COEF[k]
    first = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return mix(total[first]), first


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence, apart from those of n-grams."""
    return mix((hashes * _COEF[: len(hashes)]).sum(dtype=U, keepdims=True) + np.array([len(hashes)], U) * _COEF[62])


def bounds(rows: np.ndarray, count: int) -> np.ndarray:
    """For sorted row numbers: where each of `count` rows begins, and the end."""
    return np.searchsorted(rows, np.arange(count + 1), "left")


def shingle_sets(column, n: int = 5):
    """For each row of a string column the sorted distinct n-word shingle hashes.

    A-Z is lower-cased; fewer than n words give one shingle, no words none.
    """
    for a, b in row_blocks(column):
        data, offsets = utf8(column.slice(a, b - a))
        h, rows, _, _ = words(data, offsets, SPACE, True)
        g, first = ngrams(h, rows, n)
        word_at, gram_at = bounds(rows, b - a), bounds(rows[first], b - a)
        for i in range(b - a):
            if gram_at[i] < gram_at[i + 1]:
                yield np.unique(g[gram_at[i] : gram_at[i + 1]])
            elif word_at[i] < word_at[i + 1]:
                yield sequence_hash(h[word_at[i] : word_at[i + 1]])
            else:
                yield np.zeros(0, U)
