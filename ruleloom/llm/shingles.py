"""Word shingles of whole texts as 64-bit hashes, vectorised over UTF-8 bytes.

A text is lower-cased for A-Z only; a word is a longest run of bytes outside
0x20 and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``; UTF-8 never uses those bytes inside
a longer character).  All arithmetic wraps modulo 2**64: a prefix sum of
``byte * BASE**position`` gives each word's polynomial hash without a loop over
words, and a finaliser spreads its bits.

Defined cases: null and empty texts and texts without a word have no shingle; a
text with fewer words than ``k`` has one shingle, its whole word sequence.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = _powers(_BASE, _CHUNK), _powers(_INVERSE, _CHUNK)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_INVERSE, size)


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word of ``data`` (UTF-8), in order."""
    return word_spans(data)[0]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of ``data`` (UTF-8), in order, with the places where it starts and ends."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U), starts, ends
    _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(_U) + _U(1)) * _UP[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(_U)), starts, ends


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-word window, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    width = min(k, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - width + 1, width, _U)
        for i in range(width):
            out = mix(out) + words[i : len(words) - width + 1 + i]
        return mix(out)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, ascending."""
    if not text:
        return np.empty(0, _U)
    return window_set(word_hashes(text.encode("utf-8", "surrogatepass")), k)


def window_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of ``windows``, ascending."""
    out = windows(words, k).copy()
    out.sort()
    if len(out) > 1:
        out = out[np.concatenate(([True], out[1:] != out[:-1]))]
    return out


def seeds(n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and additive terms of ``n`` hash functions."""
    with np.errstate(over="ignore"):
        at = np.arange(1, 2 * n + 1, dtype=_U) * _U(_BASE) + _U(salt)
        drawn = mix(at)
    return drawn[:n] | _U(1), drawn[n:]


def minhash(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set."""
    least = np.full(len(multiply), ~_U(0), _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _CHUNK):
            part = shingles[at : at + _CHUNK, None] * multiply + add
            np.minimum(least, part.min(axis=0), out=least)
    return least


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
