"""Byte-level helpers, fingerprints, tokens, packing, repeats and licenses against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import bpe_tree, bytesx, licenses, multiset_hash, packing, repeats, suffix_groups

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "\n\n", "a", "é漢🙂 x", "one two three four five six seven", "tab\tand nbsp  two", "x" * 5000, "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, h string, score double"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 1, "k", "h", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shingles_are_those_of_words():
    r = random.Random(2)
    texts = ["".join(r.choice("abC \n\x0b") for _ in range(r.randint(0, 40))).encode() for _ in range(300)] + [b"", b" "]
    h, bounds, _ = bytesx.shingles(texts, 3)
    seen: dict = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        want = [tuple(w)] if 0 < len(w) < 3 else list(zip(w, w[1:], w[2:]))
        got = h[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        s = [r.randint(0, r.choice([0, 1, 2, 9])) for _ in range(r.randint(0, 40))]
        sa = suffix_groups.suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])


def plain_repeats(texts, length):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        left = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("split", [2048, 2])
def test_repeats(spark, split, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", split)
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh é") for _ in range(400)) for _ in range(6)]
    texts = list(ODD)
    for _ in range(60):
        t = "".join(r.choice(base)[r.randint(0, 200) :][: r.randint(20, 300)] if r.random() < 0.6 else "".join(r.choice("xyz ") for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 4)))
        texts.append(t)
    texts += [base[0], base[0], base[1] + base[1], "ab" * 300, "ab" * 301]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.removed_digest(frame(spark, texts), 60).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats(texts, 60)
    left = repeats.without_repeats(frame(spark, texts), 60)
    assert left.columns == frame(spark, []).columns and left.count() == len(texts)
    assert all((x.text or "") == "" or x.n_chars == len(x.text) for x in left.collect())


def test_repeats_of_nothing(spark):
    assert repeats.removed_digest(frame(spark, [])).count() == 0
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_bpe_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = bpe_tree.TreeCoder.load(path, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(5)
    texts = list(ODD) + ["".join(r.choice(r.choice(["ab", "aaab", " \n\tab's", "0123 !?", "漢字🙂ab ", "etaoinshrdlu"])) for _ in range(r.choice([3, 40, 400]))) for _ in range(300)]
    for t in texts:
        assert list(memoryview(coder.encode_packed(t or "")).cast("I")) == lib.encode_ordinary(t or "")
    got = {x.doc_id: x for x in bpe_tree.encode_documents(frame(spark, texts[:40]), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts[:40]):
        ids = lib.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_tree.encode_documents(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_joins_grow_their_window():
    ranks = {bytes([i]): i for i in range(256)}
    for k, m in enumerate([b"ab", b"abab", b"ba", b"abababab"]):
        ranks[m] = 256 + k
    coder = bpe_tree.TreeCoder(ranks, r"\S+|\s+")
    for n in (1, 5, 24, 25, 97, 401):
        b = (b"ba" * n)[: n + n // 3]
        assert coder.encode_bytes(b) == coder.leaf(b)
        assert base64.b64encode(b"".join(coder.spelling[t] for t in coder.encode_bytes(b))) == base64.b64encode(b)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = packing.WordCoder(path)
    texts = list(ODD) + ["İstanbul ² ½ ΣΑΣ", "don't we'll 's", "Á é", "word-12 ab_c ###%%"] + ["the cat sat on the mat " * k for k in (1, 50, 400, 900)]
    want = {i: [*coder.lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack_documents(frame(spark, texts), path).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append((x.start, x.length))
        seqs[x.sequence_id].append((x.offset, x.length))
        ids = want[x.doc_id][x.start : x.start + x.length]
        assert x.ids_crc32 == zlib.crc32(array("I", ids).tobytes()) and x.doc_tokens == len(want[x.doc_id])
    for i, ids in want.items():
        at = 0
        for a, n in sorted(pieces[i]):
            assert a == at
            at += n
        assert at == len(ids)
    for s in seqs.values():
        at = 0
        for a, n in sorted(s):
            assert a == at
            at += n
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_pack_balances_and_fills():
    r = random.Random(6)
    for _ in range(300):
        n = [r.choice([1, 2, 100, 2047, 2048, 2049, 5000, r.randint(1, 3000)]) for _ in range(r.randint(1, 40))]
        got, size = Counter(), Counter()
        for d, _, k, s, _ in packing.pack(n):
            got[d] += k
            size[s] += k
        assert [got[i] for i in range(len(n))] == n and all(v == 2048 or v & (v - 1) == 0 for v in size.values())


def test_fingerprints(spark):
    r = random.Random(7)
    texts = list(ODD) + ["\n".join(" ".join(r.choice(["red", "blue", "sun", "moon", "tree", "sea", "sky"]) + str(r.randint(0, 99)) for _ in range(30)) for _ in range(5)) for _ in range(20)]
    rows = {x.doc_id: x for x in multiset_hash.fingerprint_documents(frame(spark, texts), parts=3).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        new = multiset_hash.edited(t, plain[(i + 1) % len(plain)])
        assert rows[i].n_chars == len(t) and rows[i].fingerprint == multiset_hash.fingerprint(t)
        assert rows[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert rows[i].edited_fingerprint == multiset_hash.fingerprint(new)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        if i >= len(ODD):
            assert rows[i].near_edited > 0.55 and (i == len(plain) - 1 or rows[i].near_next < 0.35)
    a, b = "p one two\nq three\nr", "r\np one two\nq three"
    assert multiset_hash.fingerprint(a) == multiset_hash.fingerprint(b) != multiset_hash.fingerprint(a + "\nr")
    assert multiset_hash.fingerprint_documents(frame(spark, [])).count() == 0
    assert multiset_hash.fingerprint_documents(frame(spark, ["solo text here"])).collect()[0].near_next == 1.0
    again = multiset_hash.fingerprint_documents(frame(spark, ["t", "t", "t", None]).withColumn("doc_id", F.lit(None).cast("long")))
    assert again.count() == 4


def test_licenses(spark):
    texts = [None, "", "none here", "intro words " * 50 + "Released under the MIT License. more", "licensed UNDER the apache license version 2.0", "A license. Licensed under CC BY-NC 4.0. The MIT License is other.", "Permission is hereby granted, free of charge, to any one obtaining a copy of this software and associated docs (the Software), to deal in the Software without restriction"]
    got = {x.doc_id: x for x in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert [got[i].license for i in range(len(texts))] == [None, None, None, "MIT", "Apache-2.0", "CC-BY-NC-4.0", "MIT-text"]
    assert got[0].coverage == 0 and got[0].first_word == -1 and got[3].coverage == 1.0
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
    assert licenses.align("a x b c".split(), "a b y c".split()) == [(0, 0), (2, 1), (3, 3)]
    assert [licenses.rising(v) for v in ([], [3, 1, 2], [1, 2, 3])] == [[], [1, 2], [0, 1, 2]]


def test_every_license_that_reaches_the_threshold(spark):
    full = licenses.all_templates()
    texts = [
        "Some words.\nAll rights reserved.",
        "Released under the MIT License. All rights reserved. Licensed under the Apache License, Version 2.0.",
        "Redistribution and employ in source and binary shapes, with or without change, are allowed provided that the following conditions are met",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "intro " * 30 + full["MIT-full"] + "\n" + full["MIT-full"] + " outro" * 30,
        full["GPL-3.0-full"],
        "Released under the MIT License. " * 3,
    ]
    got = sorted((x.doc_id, x.license) for x in licenses.scan_licenses(frame(spark, texts)).collect())
    assert got == [(0, "All-rights-reserved"), (1, "All-rights-reserved"), (1, "Apache-2.0"), (1, "MIT"), (2, "BSD-3-Clause"), (3, "LGPL-3.0"), (4, "MIT-full"), (4, "MIT-text"), (5, "GPL-3.0-full"), (5, "GPL-3.0-notice"), (6, "MIT")]
    s = licenses.Scanner(full)
    for name, text in full.items():
        assert (name, 1.0) in [x[:2] for x in s.all("foo bar " * 40 + text + " baz" * 40)]
