"""Vectorised words: 64-bit hashes of the words of many texts at once, without a Python object per word.

A word is a run of characters other than space and U+0009 to U+000D; A-Z are lower-cased. Every text byte is
mapped to a fixed 64-bit value and weighted with a power of an odd base, so that a prefix sum gives the hash of
any byte range; a finaliser mixes the result. Equal words have equal hashes; different words collide with
a probability of about 2^-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: A word's hash never is this value's hash by construction of a text: it stands for the end of a text.
END_WORD = np.uint64(0x5BD1E9955BD1E995)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), wrapping."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@lru_cache(1)
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^j and base^-j modulo 2^64 for j < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and each text's first word's place (n+1 offsets)."""
    n = len(raw)
    n_texts = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    inside = ~_is_space()[raw]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1] | begins[1:]
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_byte_values()[raw] * up[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes = mix(hashes ^ (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each text, in order and with repeats, and n+1 offsets.

    A text with one to k-1 words has one shingle: the whole sequence. One without words has none.
    """
    n_words = np.diff(first)
    total = len(words)
    with np.errstate(over="ignore"):
        if total >= k:
            all_at = np.zeros(total - k + 1, np.uint64)
            for j in range(k):
                all_at = mix(all_at ^ words[j : total - k + 1 + j]) + np.uint64(j + 1)
            all_at = mix(all_at)
        else:
            all_at = np.zeros(0, np.uint64)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(out)) - out_first[:-1][owner] + first[:-1][owner]
    long_enough = (n_words >= k)[owner]
    out[long_enough] = all_at[place[long_enough]]
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        h = np.zeros(1, np.uint64)
        for j, w in enumerate(words[first[i] : first[i + 1]]):
            h = mix(h ^ w) + np.uint64(j + 101)
        out[out_first[i]] = mix(h)[0]
    return out, out_first
