"""Word and shingle hashes of many texts at once, in numpy.

A word is a maximal run of letters, digits and underscores of the lower-cased text; each Han,
kana or Hangul character is a word of its own, as such scripts are written without spaces.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal outputs; similar inputs, unrelated outputs."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(salt))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0: no part of a word, 1: part of a word, 2: a word of its own."""
    kinds = np.fromiter((c == "_" or c.isalnum() for c in map(chr, range(0x10000))), np.uint8, 0x10000)
    for low, high in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)):
        kinds[low : high + 1] *= 2
    return kinds


@lru_cache(1)
def _powers() -> np.ndarray:
    return seeds(1024, 11) | U(1)


def hash_words(texts: list[str], spans: bool = False):
    """(hashes, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]].

    With spans also the first character and the one past the last of each word in its text.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.zeros(len(low) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)), out=begins[1:])
    if not len(codes):
        none = np.zeros(0, np.int64)
        return (np.zeros(0, U), np.zeros(len(low) + 1, np.int64), none, none) if spans else (np.zeros(0, U), np.zeros(len(low) + 1, np.int64))
    kind = _kinds()[np.minimum(codes, 0xFFFF)]
    kind[(codes >= 0x20000) & (codes < 0x33480)] = 2
    at = np.flatnonzero(kind)
    own = kind[at]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | (own[1:] == 2) | (own[:-1] == 2)
    starts = np.flatnonzero(first)
    if not len(starts):
        hashes = np.zeros(0, U)
        begin = end = np.zeros(0, np.int64)
    else:
        lengths = np.diff(np.append(starts, len(at)))
        within = np.arange(len(at)) - np.repeat(starts, lengths)
        with np.errstate(over="ignore"):
            values = mix(codes[at].astype(U) + U(1)) * _powers()[within & 1023]
            hashes = mix(np.add.reduceat(values, starts) + lengths.astype(U))
        begin = at[starts]
        end = at[starts + lengths - 1] + 1
    offsets = np.searchsorted(begin, begins, side="left")
    if spans:
        doc = np.repeat(begins[:-1], np.diff(offsets))
        return hashes, offsets, begin - doc, end - doc
    return hashes, offsets


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text that isn't empty has one run, of all its words."""
    if not len(words):
        return np.zeros(0, U)
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = mix(h * U(0xD1342543DE82EF95) + words[j : j + n].astype(U) + U(j + 1))
    return h
