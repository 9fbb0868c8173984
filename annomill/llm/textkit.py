"""Word hashes and sliding windows over whole Arrow columns with numpy.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D), so UTF-8 letters stay whole. A word's hash is a
polynomial over its bytes modulo 2^64, and a window's hash a polynomial over its words' hashes, both finished with a
64-bit mixer: runs of words with other white space between them, in any document, have the same hash.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
#: Odd multipliers and their mixers.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixer of 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    return _powers(base, 1 << max(16, int(n - 1).bit_length()))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def word_spans(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts and ends, and how many words each row has. Words end at the end of a row."""
    full = np.ones(len(text) + 1, bool)
    full[:-1] = ~((text == 32) | ((text >= 9) & (text <= 13)))
    full[-1] = False
    edge = np.zeros(len(text) + 1, bool)
    edge[at] = True
    before = np.empty_like(full)
    before[0], before[1:] = False, full[:-1]
    starts = np.flatnonzero(full & (~before | edge))
    ends = np.flatnonzero(before & (~full | edge))
    return starts, ends, np.diff(np.searchsorted(starts, at))


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(text) + 1, U)
    np.cumsum((text.astype(U) + U(1)) * powers(BYTE_BASE, len(text)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse(BYTE_BASE), len(text) + 1)[starts])


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of so many words; rows are not told apart here."""
    if len(words) < length:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(WORD_BASE, len(words)), out=sums[1:])
    n = len(words) - length + 1
    return mix((sums[length:] - sums[:n]) * powers(inverse(WORD_BASE), n))


def sliding(x: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each run of width values."""
    best = np.minimum if least else np.maximum
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[:n], x[width - have : width - have + n])


def in_sorted(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values of x are in the sorted array; runs of equal values are looked up once."""
    if not len(x) or not len(known):
        return np.zeros(len(x), bool)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    at = np.searchsorted(known, x[first])
    found = known[np.minimum(at, len(known) - 1)] == x[first]
    return np.repeat(found, np.diff(np.append(first, len(x))))
