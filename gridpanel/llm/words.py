"""Words of many texts at once: boundaries and 64-bit hashes from array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(keep) -> np.ndarray:
    """256 booleans: whether a byte belongs to a word; bytes above 127 are parts of letters."""
    return np.array([b > 127 or keep(chr(b)) for b in range(256)])


ALNUM = byte_class(str.isalnum)
ALPHA = byte_class(str.isalpha)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which ``span_hash`` takes the hash of any span of ``data``."""
    size = 1 << max(16, int(len(data)).bit_length())  # few distinct sizes are cached
    inverse = _powers(size, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values()[data] * inverse[: len(data)], out=sums[1:])
    return sums, _powers(size, _BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def span_hash(sums: np.ndarray, powers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end); equal spans have equal hashes anywhere."""
    return mixed((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every word of the rows data[offsets[i]:offsets[i + 1]]."""
    inside = member[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    firsts, lasts = offsets[:-1], offsets[1:] - 1
    before[firsts[firsts < len(data)]] = False
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends
