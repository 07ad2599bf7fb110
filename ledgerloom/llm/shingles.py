"""Word shingle sets as sorted arrays of 64-bit hashes, computed for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import text_bytes

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only
_TABLE_LOWER = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B = int(_rng.integers(1, 2**62)) * 2 + 1
_B_INVERSE = pow(_B, -1, 2**64)
_STEP = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_powers: dict[int, np.ndarray] = {}
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = np.cumprod(step)
    return _powers[base][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word and the text it stands in: words are runs without ASCII white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[offsets < n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:] & ~first[1:n]
    ends = np.flatnonzero(inside & ~after) + 1
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        # A run of whole words of up to BLOCK bytes, or one longer word: sums of 8 bytes a character exist for one run at a time.
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        run = data[base : ends[to - 1]]
        total = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(_TABLE_LOWER[run] * _power(_B, len(run)), out=total[1:])
        left, right = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mix((total[right] - total[left]) * _power(_B_INVERSE, len(run))[left])
        at = to
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text its distinct k-word shingles, sorted; with fewer words the whole sequence as one; no words: empty."""
    data, offsets = text_bytes(texts)
    words, where = word_hashes(data, offsets)
    bounds = np.searchsorted(where, np.arange(len(texts) + 1))
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled = rolled * _STEP + words[j : j + len(rolled)]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in words[a:b]:
                whole = np.uint64((int(whole) * int(_STEP) + int(h)) % 2**64)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
