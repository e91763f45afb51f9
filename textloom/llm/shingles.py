"""Sets of word shingles as 64-bit hashes, and Fast Similarity Sketches of them, in numpy."""

from __future__ import annotations

import math

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20_240_601).integers(0, 1 << 64, 256, np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}

EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        size = max(1 << 14, 1 << n.bit_length())
        found = np.ones(size, np.uint64)
        found[1:] = np.uint64(base)
        found = np.multiply.accumulate(found)
        _powers[base] = found
    return found[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased."""
    a = np.frombuffer(text.lower(), np.uint8)
    if not len(a):
        return EMPTY
    white = _WHITE[a]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start = edge[~white[edge]]
    stop = edge[white[edge]]
    if not white[0]:
        start = np.concatenate(([0], start))
    if not white[-1]:
        stop = np.concatenate((stop, [len(a)]))
    if not len(start):
        return EMPTY
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[a] * powers(_BASE, len(a)), dtype=np.uint64)))
    return mix((total[stop] - total[start]) * powers(_INVERSE, len(a))[start] + (stop - start).astype(np.uint64))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a shorter text is one shingle, a text without words none."""
    w = word_hashes(text)
    if not len(w):
        return EMPTY
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h ^ w[j : j + len(h)]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(small) + len(large) - both)


def sketch(s: np.ndarray, bins: int) -> np.ndarray:
    """Fast Similarity Sketch of a non-empty set.

    Rounds 0 to bins-1 hash every element to a bin and a value, the round first; rounds bins to 2*bins-1 put all elements into one bin each. A bin
    keeps its least value, so it holds the first round that reached it and rounds after all bins are full change nothing. They are run in blocks.
    """
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    block = max(1, 4 * bins // len(s))
    first = 0
    while first < bins:
        rounds = np.arange(first, min(bins, first + block), dtype=np.uint64)
        h = mix(s[None, :] + (rounds * np.uint64(_BASE) + np.uint64(1))[:, None])
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        value = (rounds << np.uint64(48))[:, None] | (mix(h) >> np.uint64(16))
        np.minimum.at(out, place.ravel().astype(np.intp), value.ravel())
        first += len(rounds)
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        r = bins + int(i)
        own = mix(mix(s + np.uint64((r * _BASE + 1) % (1 << 64))))
        out[i] = np.uint64(r << 48) | (own >> np.uint64(16)).min()
    return out


def banding(percent: int, rows: int = 5, miss: float = 1e-8) -> int:
    """Bands of ``rows`` coordinates so that a pair at the threshold shares none with a chance of ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def bands(s: np.ndarray, count: int, rows: int = 5) -> tuple[np.ndarray, bytes]:
    """A set's band values, where equal ones mean equal coordinates in the same band; and the low byte of every coordinate."""
    found = sketch(s, count * rows)
    coords = found.reshape(count, rows)
    h = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE)
    for j in range(rows):
        h = mix(h ^ coords[:, j]) + np.uint64(_BASE)
    return h.view(np.int64), found.astype(np.uint8).tobytes()


def agreement(percent: int, coordinates: int, miss: float = 1e-9) -> int:
    """Coordinates that two sketches share at least, but for a chance of ``miss``, if their sets are at the threshold: a binomial tail."""
    p, total = percent / 100, 0.0
    for c in range(coordinates + 1):
        total += math.exp(math.lgamma(coordinates + 1) - math.lgamma(c + 1) - math.lgamma(coordinates - c + 1) + c * math.log(p) + (coordinates - c) * math.log1p(-p)) if p < 1 else float(c == coordinates)
        if total > miss:
            return c
    return coordinates
