"""Vectorised 64-bit codes of bytes, words and runs of words in Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are coded at once; a longer text is a piece of its own.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, ``n`` of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 2), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * PIECE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of ``(byte + 1) * base^i``: differences give the code of any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=out[1:])
    return out


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of the substrings [start, end), wherever they stand."""
    back = _power(_BACK, len(total))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEP)


def grams(total: np.ndarray, k: int) -> np.ndarray:
    """Codes of all substrings of ``k`` bytes."""
    n = len(total) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((total[k:] - total[:n]) * _power(_BACK, n))


def runs(codes: np.ndarray, w: int) -> np.ndarray:
    """Codes of all runs of ``w`` consecutive items."""
    n = len(codes) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, w, np.uint64)
    for j in range(w):
        out *= _STEP
        out += codes[j : j + n]
    return mix(out)


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of a text column, in pieces of bounded size. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: starts, ends, codes, and the bounds of each row's words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    here = inside[1:-1]
    starts = np.flatnonzero(here & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(here & (~inside[2:] | first[1:])) + 1
    codes = spans(sums(LOWER[data] if lower else data), starts, ends)
    return starts, ends, codes, np.searchsorted(starts, offsets, "left")


def shingle_sets(codes: np.ndarray, bounds: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct codes of its ``w``-word shingles; of fewer words, their whole run."""
    every = runs(codes, w)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= w:
            yield np.unique(every[a : b - w + 1])
        elif b > a:
            yield runs(codes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
