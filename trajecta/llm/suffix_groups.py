"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix.  Groups are processed from the
highest to the lowest: every member finds the nearest suffix before it that
stands in a lower group (its previous-smaller pointer); those suffixes have a
longer Lyndon prefix than was known, one that goes on with the processed group,
and move to a group of their own just above what stays of theirs, the more
repeats the higher.  After that the suffixes are emitted group by group along
the same pointers; nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols) -> list[int]:
    """Starts of the suffixes in ascending order; a suffix that ends sorts first."""
    s = np.asarray(symbols, dtype=np.int64)
    n = len(s) + 1
    if n == 1:
        return []
    _, ranks = np.unique(s, return_inverse=True)
    ranks = np.concatenate([ranks.ravel() + 1, [0]])
    order = np.argsort(ranks, kind="stable")
    sizes = np.bincount(ranks)
    first = np.cumsum(sizes) - sizes
    group = first[ranks].tolist()
    sa = order.tolist()
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)
    where = where.tolist()
    size = [0] * n
    for f, z in zip(first.tolist(), sizes.tolist(), strict=True):
        size[f] = z
    smaller = [-1] * n
    skip = list(range(-1, n - 1))
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        members = sorted(sa[start:end]) if end - start > 1 else [sa[start]]
        repeats: dict[int, int] = {}
        for i in members:
            p = i - 1
            if p >= 0 and group[p] >= start:
                path = []
                while p >= 0 and group[p] >= start:
                    path.append(p)
                    p = skip[p]
                for q in path:
                    skip[q] = p
            smaller[i] = skip[i] = p
            if p >= 0:
                repeats[p] = repeats.get(p, 0) + 1
        end = start
        if not repeats:
            continue
        top = max(repeats.values())
        by = [list(repeats)] if top == 1 else [[j for j, c in repeats.items() if c == k] for k in sorted(set(repeats.values()), reverse=True)]
        for some in by:
            for j in some:
                g = group[j]
                size[g] -= 1
                last, at = g + size[g], where[j]
                other = sa[last]
                sa[at], sa[last] = other, j
                where[other], where[j] = at, last
            moved: dict[int, int] = {}
            for j in some:
                g = group[j]
                if g not in moved:
                    moved[g] = g + size[g]
            for j in some:
                new = moved[group[j]]
                group[j] = new
                size[new] += 1
    out = [0] * n
    free = list(range(n))
    placed = bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out[1:]


def common_prefixes(symbols: list[int], sa: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it."""
    n = len(sa)
    rank = [0] * n
    for i, p in enumerate(sa):
        rank[p] = i
    out, h = [0] * n, 0
    for p in range(n):
        r = rank[p]
        if r == 0:
            h = 0
            continue
        q = sa[r - 1]
        top = n - max(p, q)
        while h < top and symbols[p + h] == symbols[q + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
