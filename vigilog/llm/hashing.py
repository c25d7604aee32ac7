"""Hashes of words and of word shingles for whole batches of texts, in numpy.

A word is a run of bytes outside blank, tab, newline, vertical tab, form feed and return.
Its hash is a polynomial over the bytes with random byte values, mixed to 64 bits; A-Z
count as a-z where ``lower`` is set.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C13)
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing permutation (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


EXACT = mixed(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]

_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 .. n-1."""
    global _powers
    if len(_powers) < n:
        factors = np.full(1 << (n - 1).bit_length() if n > 64 else 64, BASE)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers[:n]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte length of each word, and the words before each text (n + 1)."""
    solid = SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] |= solid[begins]
    at = np.flatnonzero(first)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    places = np.flatnonzero(solid)
    starts = np.flatnonzero(first[places])
    lengths = np.diff(np.append(starts, len(places)))
    inside = np.arange(len(places)) - np.repeat(starts, lengths)
    table = LOWER if lower else EXACT
    values = table[data[places]] * powers(int(lengths.max()))[inside]
    hashes = mixed(np.add.reduceat(values, starts) ^ mixed(lengths.astype(U)))
    return hashes, at, lengths, np.searchsorted(at, offsets)


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text of fewer words has its whole word sequence as its one shingle, a text
    without words has none.
    """
    salts = mixed(np.arange(1, size + 2, dtype=U))
    n = len(hashes)
    joined = np.zeros(max(0, n - size + 1), U)
    for j in range(size):
        joined += mixed(hashes[j : n - size + 1 + j] ^ salts[j]) * powers(size)[j] if len(joined) else joined
    joined = mixed(joined)
    out = []
    for begin, end in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if end - begin >= size:
            out.append(np.unique(joined[begin : end - size + 1]))
        elif end > begin:
            short = sum(int(mixed(hashes[begin + j : begin + j + 1] ^ salts[j])[0]) * pow(int(BASE), j, 2**64) for j in range(end - begin))
            out.append(mixed(np.array([(short + int(salts[size]) * (end - begin)) % 2**64], U)))
        else:
            out.append(np.zeros(0, U))
    return out
