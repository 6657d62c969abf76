"""One-permutation MinHash over word shingles, and packed low-order bits of it.

A text's shingles are hashed once.  The high bits of a hash choose one of ``bins`` bins, the rest
is its value, and each bin keeps the least value.  An empty bin copies another by optimal
densification: it walks a fixed random sequence of bins, the same for all texts, to the first one
that holds a value.  Two texts agree in a bin with the chance of their Jaccard similarity.

With ``bits`` low-order bits of each bin kept, unequal values agree by chance in 1 of 2 ** bits
bins; ``likeness`` takes this bias out.
"""

from __future__ import annotations

import numpy as np

from relayloom.llm.wordhash import MULTIPLIER, Words, inside_texts, mix, windows

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(w: Words, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``k`` words; of fewer words, of all of them as one."""
    runs = windows(w.hashes, k)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(mix(windows(w.hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def flat_shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' runs of ``k`` words, with repetitions, and the text of each; as in ``shingles``."""
    counts = np.diff(w.first)
    good = np.flatnonzero(inside_texts(w.first, k))
    h, text = [windows(w.hashes, k)[good]], [np.searchsorted(w.first, good, side="right") - 1]
    for i in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        a, b = int(w.first[i]), int(w.first[i + 1])
        h.append(mix(windows(w.hashes[a:b], b - a) + np.uint64(b - a)))
        text.append(np.array([i]))
    return np.concatenate(h), np.concatenate(text)


def _probes(bins: int, step: int) -> np.ndarray:
    return (mix(np.arange(bins, dtype=np.uint64) * np.uint64(MULTIPLIER) + np.uint64(step + 1)) % np.uint64(bins)).astype(np.int64)


_FIRST: dict[int, np.ndarray] = {}


def _first_step(bins: int) -> np.ndarray:
    """When the walk of bin i (row) first meets bin j; one that is never met in 8 * bins steps comes by distance after that."""
    if bins not in _FIRST:
        i = np.arange(bins)
        table = (8 * bins + (i[None, :] - i[:, None]) % bins).astype(np.int32)
        for step in range(8 * bins - 1, -1, -1):
            table[i, _probes(bins, step)] = step
        _FIRST[bins] = table
    return _FIRST[bins]


def one_permutation(h: np.ndarray, text: np.ndarray, n: int, bins: int) -> np.ndarray:
    """A row of ``bins`` values for each of ``n`` texts from shingle hashes; one without any is all EMPTY."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    sketch = np.full(n * bins, EMPTY, dtype=np.uint64)
    np.minimum.at(sketch, text * bins + (h >> shift).astype(np.int64), mix(h) >> np.uint64(1))
    sketch = sketch.reshape(n, bins)
    full = sketch != EMPTY
    held = full.sum(axis=1)
    filled = sketch.copy()
    few = (held > 0) & (held <= bins // 8)
    if few.any():  # looked up: a walk would be long
        first = _first_step(bins)
        for r in np.flatnonzero(few).tolist():
            some = np.flatnonzero(full[r])
            got = sketch[r, some[first[:, some].argmin(axis=1)]]
            filled[r] = np.where(full[r], sketch[r], got)
    row, col = np.nonzero(~full & (held > bins // 8)[:, None])
    for step in range(8 * bins):
        if not len(row):
            break
        got = sketch[row, _probes(bins, step)[col]]
        good = got != EMPTY
        filled[row[good], col[good]] = got[good]
        row, col = row[~good], col[~good]
    if len(row):
        first = _first_step(bins)
        for r, c in zip(row.tolist(), col.tolist(), strict=True):
            some = np.flatnonzero(full[r])
            filled[r, c] = sketch[r, some[first[c, some].argmin()]]
    return filled


def packed(sketch: np.ndarray, bits: int = 8) -> np.ndarray:
    """The low-order bits of each bin as bytes (``bits`` is 1, 2, 4 or 8).

    A value is mixed with its bin's number first: a short text has the same few values in many bins, and
    chance agreements of their bits must not come in all of these bins together.
    """
    place = np.arange(sketch.shape[1], dtype=np.uint64) * np.uint64(MULTIPLIER)
    low = (mix(sketch ^ mix(place)) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low
    per = 8 // bits
    low = low.reshape(len(low), -1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint8) * bits), axis=2).astype(np.uint8)


def unpacked(codes: np.ndarray, bits: int = 8) -> np.ndarray:
    if bits == 8:
        return codes
    per = 8 // bits
    return ((codes[:, :, None] >> (np.arange(per, dtype=np.uint8) * bits)) & np.uint8((1 << bits) - 1)).reshape(len(codes), -1)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray, bits: int = 8) -> np.ndarray:
    """Estimated Jaccard similarity of each row of packed codes; 1 for two empty sets, 0 for one."""
    agree = (unpacked(a, bits) == unpacked(b, bits)).mean(axis=1)
    chance = 1 / (1 << bits)
    found = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), found)
