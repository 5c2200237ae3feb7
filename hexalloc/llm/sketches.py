"""Shingle sets of texts and their HyperMinHash registers.

A word's hash is XXH64 of its lower-cased bytes; a shingle's is a mix of its words'
hashes; a set is the sorted array of distinct shingle hashes.  Register k keeps the
least value of a multiplicative hash over the set, stored in 16 bits as HyperMinHash
does: the number of leading zeros (6 bits) and the ten bits after the leading one.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bands of rows; a pair at similarity 0.85 shares no band with probability (1 - 0.85^6)^40 < 6e-9.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
MEMORY_WORDS = 200_000

_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Sets:
    """Shingle sets of texts; remembers words' hashes."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """Distinct shingles, sorted. Fewer words than a shingle make one; no words, none."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in (w for w in set(words) if w not in known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        s = np.full(len(words) - k + 1, k * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for i in range(k):
            s = mix(s * _SHINGLE[i % 5] + h[i : len(words) - k + 1 + i])
        return np.unique(s)


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima, in 16 bits. Equal minima stay equal."""
    least = np.maximum(least, np.uint64(1))
    # The exponent of a double is the place of the leading one; rounding up may pass it by one.
    place = np.frexp(least.astype(np.float64))[1] - 1
    place = np.where((place > 63) | ((least >> np.minimum(place, 63).astype(np.uint64)) == 0), place - 1, place)
    shifted = least << (63 - place).astype(np.uint64)
    mantissa = (shifted >> np.uint64(63 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((63 - place).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set that isn't empty."""
    least = np.full(REGISTERS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _MULTIPLIERS).min(0), out=least)
    return compress(least)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, rows of sketches at a time."""
    rows = sketch.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _SHINGLE[1], rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * _SHINGLE[0] + rows[:, :, i])
    return key.view(np.int64)


#: Upper bounds of the values that a count of leading zeros stands for, as shares of all.
_TOPS = 0.5 ** np.arange(64)


def same_by_chance(n: np.ndarray, m: np.ndarray, both: np.ndarray) -> np.ndarray:
    """How often registers of sets of ``n`` and ``m`` shingles, ``both`` of them shared, agree though
    their minima differ.

    Let x be the least value of the union and one set's own.  The other set's least value is above
    it, and falls into the same cell of values with its size times what is left of the cell, half
    its width on average.  Cells under a top t are t * 2^-(MANTISSA + 1) wide, and x is between t / 2
    and t with the chance that all of the union is above t / 2 and not above t."""
    union = np.maximum(n + m - both, 1.0)[..., None]
    between = (1 - _TOPS / 2) ** union - (1 - _TOPS) ** union
    width = (between * _TOPS).sum(-1) * 2.0 ** -(MANTISSA + 1)
    only_n, only_m = np.maximum(n - both, 0.0), np.maximum(m - both, 0.0)
    other = (only_n * m + only_m * n) / np.maximum(only_n + only_m, 1e-9)
    return np.clip(other * width / 2, 0.0, 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of sketches of sets of ``n`` and ``m`` shingles, without the matches
    that compression makes."""
    n, m = np.asarray(n, float), np.asarray(m, float)
    raw = (a == b).mean(-1)
    chance = same_by_chance(n, m, raw * (n + m) / (1 + raw))
    return np.clip((raw - chance) / (1 - chance), 0.0, 1.0)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for sorted sets that aren't empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
