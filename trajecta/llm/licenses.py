"""License scans by patience alignment.

Text and template are aligned on the words that occur once in both: the
longest run of them that ascends in both is kept, and the gaps between them
are aligned the same way.  Coverage is the share of the template's words that
are matched.  A text is looked at around every place where words stand that a
short template cannot do without, and a long template is laid over all of the
text, in windows of three times its length; every place is looked at.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajecta.llm import bytesx as B
from trajecta.ship import ship

_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
    "BSD": "Released under the BSD License.",
    "ISC": "Released under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-short": "Licensed under CC BY-NC-ND 4.0.",
}
_CC = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."
TEMPLATES |= {f"CC-BY-{k}-4.0-notice": _CC.format(v) for k, v in {"SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial", "NC-SA": "NonCommercial-ShareAlike", "NC-ND": "NonCommercial-NoDerivatives"}.items()}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES |= {f"{k}-notice": _GNU.format(*v) for k, v in {"GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}.items()}
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
#: Templates of more words are laid over the whole text rather than around their words.
LONG = 100
#: Words that tell nothing about a license.
COMMON = frozenset("a an and any are by form forms free in is of or person source that the this to use version with without work v 3 2.0 4.0 under subject following".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly ascending subsequence (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of text a and template b, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        ca, cb = Counter(a[lo:hi]), Counter(b[low:high])
        place = {w: i for i, w in enumerate(a[lo:hi], lo) if ca[w] == 1}
        once = [(j, place[w]) for j, w in enumerate(b[low:high], low) if cb[w] == 1 and w in place]
        if not once:
            continue
        keep = [once[k] for k in rising([i for _, i in once])]
        at, below = lo, low
        for j, i in keep:
            out.append((i, j))
            todo.append((at, i, below, j))
            at, below = i + 1, j + 1
        todo.append((at, hi, below, high))
    return sorted(out)


def all_templates() -> dict[str, str]:
    """The notices, and as ``-full`` the whole texts of ``license_texts`` (read on the driver)."""
    out = dict(TEMPLATES)
    for n in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, n), encoding="utf-8") as f:
            out[n.removesuffix(".txt") + "-full"] = f.read()
    return out


def family(name: str) -> str:
    return re.sub(r"-(?:full|text|notice|short)$", "", name)


class Scanner:
    """Alignments of templates.

    Coverage of ``least`` leaves at most ``spare`` words of a template
    unmatched, so a text or window with more of its words missing is skipped,
    and one of ``keys``, words with more than ``spare`` places, must be there.
    A place where half of a notice's telling words stand is looked at too.
    """

    def __init__(self, templates: dict[str, str], least: float = 0.8):
        self.least = least
        self.templates = {k: w for k, v in templates.items() if (w := words(v))}
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.sets = {k: frozenset(v) for k, v in self.counts.items()}
        self.telling = {k: v - COMMON for k, v in self.sets.items()}
        self.spare = {k: len(b) - max(1, math.ceil(least * len(b) - 1e-9)) for k, b in self.templates.items()}
        self.keys, self.place = {}, {}
        for k, b in self.templates.items():
            got, n = set(), 0
            for w in sorted(self.sets[k], key=lambda w: (w in COMMON, self.counts[k][w], -len(w), w)):
                if n > self.spare[k]:
                    break
                got.add(w)
                n += self.counts[k][w]
            self.keys[k] = got | self.telling[k]
            self.place[k] = {w: i for i, w in reversed(list(enumerate(b)))}

    def enough(self, name: str, there: Counter) -> bool:
        miss = sum(n - c for w, n in self.counts[name].items() if (c := there[w]) < n)
        return miss <= self.spare[name]

    def windows(self, name: str, a: list[str]):
        b = self.templates[name]
        n = len(b)
        tell, place, last = self.telling[name], self.place[name], None
        if n > LONG:
            # any stretch of twice the template's length lies in one window
            for lo in range(0, max(1, len(a) - n), n):
                if self.enough(name, Counter(a[lo : lo + 3 * n])):
                    good = yield lo, lo + 3 * n
                    if good:
                        continue
                    # copies side by side blur each other's words: as if the template stood where most of its words ask for
                    asked = Counter(i - place[w] for i, w in enumerate(a[lo : lo + 3 * n], lo) if self.counts[name][w] == 1)
                    for at in sorted(asked, key=lambda x: (-asked[x], x)):
                        at = max(0, at)
                        if self.enough(name, Counter(a[at : at + n + self.spare[name]])):
                            good = yield at, at + n + self.spare[name]
                            if good:
                                break
            return
        for i, w in enumerate(a):
            if w in self.keys[name]:
                # around the word, then as if the template stood there, where another copy near can't blur the words
                for lo, hi in ((max(0, i - n), i + 2 * n), (max(0, i - place[w]), i - place[w] + n + self.spare[name])):
                    here = Counter(a[lo:hi])
                    if (lo, hi) != last and (2 * len(tell & here.keys()) >= len(tell) or self.enough(name, here)):
                        yield lo, hi
                    last = (lo, hi)

    def all(self, text: str) -> list[tuple[str | None, float, int, int, int]]:
        """Template, coverage, matched words, first and last word: the best of each license that reaches ``least``, or one row with no name.

        Words that another license matches better (no less coverage and matches, and more of one) are that one's: without them
        an alignment must still reach ``least``.
        """
        a = words(text)
        there = set(a)
        none: tuple = (None, 0.0, 0, -1, -1)
        found: dict[tuple, frozenset[int]] = {}
        for name, b in self.templates.items():
            n, tell = len(b), self.telling[name]
            missing = max(len(self.sets[name]) - len(there), 0)
            if missing <= self.spare[name]:
                missing = len(self.sets[name] - there)
            if missing > self.spare[name] and (n > LONG or not tell or 2 * len(tell & there) < len(tell)):
                continue
            spots = self.windows(name, a)
            at = next(spots, None)
            while at is not None:
                m = align(a[at[0] : at[1]], b)
                c = len(m) / n
                good = c > 0 and c >= self.least
                if good:
                    found[name, c, len(m), at[0] + m[0][0], at[0] + m[-1][0]] = frozenset(at[0] + i for i, _ in m)
                try:
                    at = spots.send(good)
                except StopIteration:
                    at = None
        owners: dict[int, list[tuple]] = {}
        if len({family(x[0]) for x in found}) > 1:
            for x, on in found.items():
                for i in on:
                    owners.setdefault(i, []).append(x)
        best: dict[str, tuple] = {}
        for x in sorted(found, key=lambda x: (x[0], -x[1], x[3])):
            if x[0] in best:
                continue
            own = sum(not any(y[1] >= x[1] and y[2] >= x[2] and y[1:3] != x[1:3] and family(y[0]) != family(x[0]) for y in owners.get(i, ())) for i in found[x])
            if own / len(self.templates[x[0]]) >= self.least:
                best[x[0]] = x
        return [best[k] for k in sorted(best)] or [none]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched, first_word and last_word: a row for each template that reaches ``least``.

    Every stretch of the text as long as the template and its spare words that
    reaches ``least`` is found, and what is found lies in a stretch of three
    times the template's words.  A text with none gives one row with a null license, coverage 0 and
    places -1, as do null and empty texts; very long texts are scanned whole.  A
    template counts at its first place of best coverage.  Repeated rows each
    give their rows; an empty table none; other columns are not read.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T._parse_datatype_string("license string, coverage double, matched long, first_word long, last_word long").fields])
    rules = dict(sorted((all_templates() if templates is None else templates).items()))

    def run(batches):
        s = Scanner(rules, least)
        for b in B.small(batches):
            got = [(i, *x) for i, t in enumerate(b.column(1).to_pylist()) for x in s.all(t or "")]
            if got:
                at, name, cover, n, lo, hi = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(cover, pa.float64()), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=schema.names)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
