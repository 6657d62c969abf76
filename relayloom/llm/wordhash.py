"""Word hashes of whole Arrow batches with numpy: no Python object a word.

A word is a run of bytes that are no white space (space and bytes 9 to 13); with ``lower`` the
letters A-Z count as a-z.  Its hash is a sum of byte times position key modulo 2 ** 64 (keys from
splitmix64), mixed once more.  A window of words has a polynomial of its words' hashes.  Two
different words or windows agree with a chance of about 2 ** -57 or less.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from relayloom.llm.common import utf8

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEYS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(MULTIPLIER)) | np.uint64(1)


def _keys(n: int) -> np.ndarray:
    global _KEYS
    if len(_KEYS) < n:
        _KEYS = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(MULTIPLIER)) | np.uint64(1)
    return _KEYS


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # n + 1 byte offsets of texts
    first: np.ndarray  # n + 1 word numbers of texts
    begin: np.ndarray  # byte offsets of words
    end: np.ndarray
    hashes: np.ndarray  # uint64


def words(column: pa.Array, lower: bool = True) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    begin = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[: len(data)] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(begin, offsets)
    return Words(data, offsets, first, begin, end, _hashes(data, begin, end))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    out = np.zeros(len(begin), dtype=np.uint64)
    lengths = end - begin
    sums = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(begin):  # about ``most`` bytes at a time
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + most)))
        to = min(to, len(begin))
        n = lengths[at:to]
        local = sums[at : to + 1] - sums[at]
        place = np.arange(local[-1]) - np.repeat(local[:-1], n)
        byte = data[np.repeat(begin[at:to], n) + place].astype(np.uint64) + np.uint64(1)
        out[at:to] = np.add.reduceat(byte * _keys(int(n.max()))[place], local[:-1])
        at = to
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomials of all runs of k hashes, by doubling; runs across texts are among them."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    m, power, length = np.uint64(MULTIPLIER), np.uint64(MULTIPLIER), 1
    out = h
    for bit in bin(k)[3:]:
        with np.errstate(over="ignore"):
            out, power, length = out[: len(out) - length] * power + out[length:], power * power, 2 * length
            if bit == "1":
                out, power, length = out[:-1] * m + h[length : length + len(out) - 1], power * m, length + 1
    return mix(out)


def inside_texts(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of k words lie in one text."""
    n = int(first[-1])
    good = np.zeros(max(0, n - k + 1), dtype=bool)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(good):
        good[:] = text[: n - k + 1] == text[k - 1 :]
    return good


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the least value of every run of w values (the last one of equal least values), each once."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    order = np.arange(len(values))
    # sparse table of minima: runs of a power of two, then two overlapping ones
    best, length = order, 1
    while 2 * length <= w:
        a, b = best[:-length], best[length:]
        best, length = np.where(values[b] <= values[a], b, a), 2 * length
    a, b = best[:n], best[w - length : w - length + n]
    return np.unique(np.where(values[b] <= values[a], b, a))


def bounds(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n + 1 offsets into the sorted word places ``at``, by text."""
    return np.searchsorted(at, first)
