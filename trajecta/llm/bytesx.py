"""Vectorised byte-level helpers shared by the text operators.

Texts are laid end to end in one uint8 buffer; words, shingles and windows are
then found and hashed with whole-array numpy operations.  Hashes are 64-bit and
the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
#: A random odd base and a random 64-bit value for each byte.
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: A second table, for hashes that have nothing to do with those of the first.
BYTE_TOO = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Bytes of work for one slice: it bounds the memory of a Python worker.
SLICE_BYTES = 1 << 19
#: Texts of one slice, however short they are.
SLICE_TEXTS = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place on a copy)."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), SLICE_BYTES + 4096)
        for name, base in (("_powers", BASE), ("_inverse", BASE_INV)):
            full = np.full(size, base, dtype=np.uint64)
            full[0] = 1
            globals()[name] = np.multiply.accumulate(full)
    return _powers, _inverse


def slices(texts: list, limit: int = SLICE_BYTES):
    """Encoded texts in runs of at most ``limit`` bytes (one text at least) and SLICE_TEXTS texts: (first, list of bytes)."""
    first, size, run = 0, 0, []
    for i, t in enumerate(texts):
        b = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        if run and (size + len(b) > limit or len(run) == SLICE_TEXTS):
            yield first, run
            first, size, run = i, 0, []
        run.append(b)
        size += len(b)
    if run:
        yield first, run


def small(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows: texts are made Python objects piece by piece."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def lay(run: list[bytes], gap: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with ``gap`` after every text; starts and ends of the texts in it."""
    buf = np.frombuffer(gap.join([*run, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, run), dtype=np.int64, count=len(run))
    ends = np.cumsum(sizes + len(gap)) - len(gap)
    return buf, ends - sizes, ends


def prefix_hash(buf: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """P with P[i] = sum of byte[buf[j]] * BASE**j for j < i."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(byte[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of buf[start:end] for each pair."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes.  Texts must be parted by a space byte."""
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(space[buf], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def shingles(run: list[bytes], n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text (fewer words: the whole sequence as one).

    Returns the hashes in text order, with repeats, the bounds of each text's
    run of hashes, and the number of words of each text.
    """
    buf, starts, _ = lay(run, b" ")
    if lower:
        buf = LOWER[buf]
    s, e = words(buf)
    h = span_hash(prefix_hash(buf), s, e)
    first = np.searchsorted(s, starts)
    count = np.diff(np.append(first, len(s)))
    made = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first, made) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], made)
    size = np.repeat(np.minimum(count, n), made)
    out = np.full(len(at), U(0xD6E8FEB86659FD93), dtype=np.uint64)
    for k in range(n):
        nxt = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else out
        step = mix(out ^ nxt) + U(k + 1)
        out = step if k == 0 else np.where(size > k, step, out)
    return mix(out), bounds, count


def distinct_runs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run sorted and without repeats, and the new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, owner)) if len(bounds) > 2 else np.argsort(h)
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(len(bounds)))
