"""Hashes of words and word shingles for whole Arrow batches at once, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Its hash is a polynomial over random byte values, modulo 2^64; the letters A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SLICE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _hash_slice(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = bounds[:-1][bounds[:-1] < n]
    start[first] = word[first]
    starts = np.flatnonzero(start)
    up, down = _powers(n)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    sums = np.add.reduceat(_VALUE[data] * up, starts)
    return mix(sums * down[starts]), np.searchsorted(starts, bounds)


def word_starts(text: bytes) -> np.ndarray:
    """The bytes at which a text's words start."""
    word = ~_SPACE[np.frombuffer(text, dtype=np.uint8)]
    word[1:] &= ~word[:-1]
    return np.flatnonzero(word)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, hashes of all words, offsets of each text's words) for slices of about a megabyte."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SLICE, side="right")) - 1)
        j = min(j, n)
        hashes, at = _hash_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield i, hashes, at
        i = j


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text, with repeats; the whole text if it has fewer words."""
    if not len(words):
        return words
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _U(3) + words[i : len(words) - n + 1 + i])
    return out
