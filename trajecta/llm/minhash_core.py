"""Circulant MinHash signatures and exact Jaccard tests, in numpy.

Two permutations of the 64-bit integers make all coordinates: ``sigma`` spreads
the shingle hashes once, and coordinate k is the smallest value of ``pi`` after
a circular shift by k steps (the integers modulo 2**64 are the circle).
"""

from __future__ import annotations

import numpy as np

from trajecta.llm import bytesx as B

ROWS = 4
#: Greatest odds that the bands miss a pair at the threshold.
MISS = 1e-5


def plan(percent: int) -> int:
    """Bands for a threshold in percent.

    Bands come in eights, as many as MISS asks for (16 at 85 percent, 24 at 80).
    """
    p, bands = percent / 100, 8
    while (1 - p**ROWS) ** bands > MISS:
        bands += 8
    return bands


_STEP = B.U(0x9E3779B97F4A7C15)
_BLOCK = 1 << 14


def sigma(x: np.ndarray) -> np.ndarray:
    return B.mix(x + B.U(0x632BE59BD9B4E019))


def _pi(x: np.ndarray, tmp: np.ndarray) -> np.ndarray:
    """A second bijection, in place; cheap, as ``sigma`` has spread the bits."""
    np.right_shift(x, B.U(32), out=tmp)
    x ^= tmp
    x *= B.U(0xD6E8FEB86659FD93)
    np.right_shift(x, B.U(29), out=tmp)
    x ^= tmp
    x *= B.U(0xA0761D6478BD642F)
    return x


def signatures(h: np.ndarray, bounds: np.ndarray, coords: int = 16 * ROWS) -> np.ndarray:
    """Rows of minima for the runs of distinct shingle hashes; all ones for an empty run."""
    n = len(bounds) - 1
    out = np.full((n, coords), np.iinfo(np.uint64).max, dtype=np.uint64)
    s = sigma(h)
    sizes = np.diff(bounds)
    first = 0
    while first < n:  # blocks that stay in the cache; a longer run is a block of its own
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _BLOCK, "right")) - 1)
        full = np.flatnonzero(sizes[first:last]) + first
        part = s[bounds[first] : bounds[last]]
        if len(full):
            at = bounds[full] - bounds[first]
            x, tmp = np.empty_like(part), np.empty_like(part)
            for k in range(coords):
                np.add(part, B.U(k * int(_STEP) % (1 << 64)), out=x)
                out[full, k] = np.minimum.reduceat(_pi(x, tmp), at)
        first = last
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands never share keys but by chance."""
    bands = sig.shape[1] // ROWS
    x = sig.reshape(len(sig), bands, ROWS)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * B.U(0x8CB92BA72F3D8DD7), x.shape[:2]).copy()
    for r in range(ROWS):
        key = B.mix(key ^ x[:, :, r]) + B.U(r + 1)
    return B.mix(key)


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits that are equal for equal sets: two sums of independent mixes, with the size."""
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    for c, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        m = B.mix(h ^ B.U(salt))
        if len(full):
            out[full, c] = np.add.reduceat(m, bounds[full])
        out[:, c] ^= np.diff(bounds).astype(np.uint64) * B.U(salt)
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted sets without repeats."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)
