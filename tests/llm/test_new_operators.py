"""Residual packing, change points and spelling variants against plain versions of themselves."""

import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import changepoints, errata_trie, residual_packing

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = "doc_id long, text string, lang string, piece int, node long, fill long, done boolean, word string, n long, key string, m int, id string"


def odd_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, True, "w", 5, "k", 6, "x") for i, t in rows], ODD)


# op11


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]


def test_coder_is_the_library():
    r = random.Random(2)
    alphabet = "abc ABC  \n\n\t\r\x0b\x0c\x1c\x85\xa0 　'srtvemlld09.,!?-_<|endoftext|>éßЖ中😀́"
    texts = ["", " ", "\n", "a  b", "a \n b", "don't  stop", " \xa0 \n x", "x" * 3000, " " * 500 + "x", "a\x1cb!\x1cc", "<|endoftext|>"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(1500)]
    coder = residual_packing.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert coder.fast
    for _ in range(2):
        for t, ids in zip(texts, library(texts), strict=True):
            assert array("I", coder.encode(t)).tolist() == ids[:-1] if t else coder.encode(t) == b""


def plain_best_fit(sizes, capacity):
    bins, where = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [b for b in range(len(bins)) if bins[b] >= sizes[k]]
        b = min(fits, key=lambda b: bins[b]) if fits else len(bins)
        if not fits:
            bins.append(capacity)
        bins[b] -= sizes[k]
        where[k] = b
    return bins


def test_best_fit_fills_as_the_plain_one():
    r = random.Random(4)
    for _ in range(200):
        cap = r.choice([5, 16, 100])
        sizes = np.array([r.randint(1, cap) for _ in range(r.randint(0, 60))], dtype=np.int64)
        which, place = residual_packing.best_fit(sizes, cap)
        used = defaultdict(list)
        for b, p, n in zip(which.tolist(), place.tolist(), sizes.tolist(), strict=True):
            used[b].append((p, n))
        for pieces in used.values():
            at = 0
            for p, n in sorted(pieces):
                assert p == at
                at += n
            assert at <= cap
        assert sorted(cap - sum(n for _, n in x) for x in used.values()) == sorted(plain_best_fit(sizes.tolist(), cap))


def check_packing(got, rows, capacity=2048):
    ids = library([t or "" for _, t in rows])
    want = Counter()
    for (i, _), x in zip(rows, ids, strict=True):
        n = len(x)
        cuts = [0] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity)]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], n], strict=True)):
            assert k == 0 or b - a == capacity
            want[i, k, a, b - a, zlib.crc32(array("I", x[a:b]).tobytes())] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    used = defaultdict(list)
    for g in got:
        used[g.sequence_id].append((g.offset, g.length))
    for pieces in used.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    total = sum(map(len, ids))
    return len(used), -(-total // capacity)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_packing_keeps_all_rows_and_wastes_little(spark, monkeypatch, parts):
    for name, value in {"ITEMS": 64, "CARRY": 40, "FAN": 3}.items():
        monkeypatch.setattr(residual_packing, name, value)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(int(r.paretovariate(0.7) * 8) % 3000))) for i in range(400)]
    rows += [(None, None), (None, ""), (3, "same"), (3, "same"), (5, " ".join(word() for _ in range(9000)))]
    got = residual_packing.pack_best_fit(odd_rows(spark, rows).repartition(parts), public_tokenizers.path("byte_bpe_50k.json"), fan=3).collect()
    used, least = check_packing(got, rows)
    assert used <= least * 1.02 + 2


def test_packing_of_texts_that_do_not_fit_together(spark, monkeypatch):
    monkeypatch.setattr(residual_packing, "CARRY", 4)
    rows = [(i, "a " * 1400) for i in range(60)]
    got = residual_packing.pack_best_fit(odd_rows(spark, rows).repartition(9), public_tokenizers.path("byte_bpe_50k.json"), fan=2).collect()
    assert check_packing(got, rows)[0] == 60
    assert residual_packing.pack_best_fit(odd_rows(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


# op12


def plain_cuts(x, least=7, penalty=20_000):
    def cost(i, j):
        y, n = x[i:j], j - i
        return n * math.floor(1000 * math.log(1 + (n * sum(v * v for v in y) - sum(y) ** 2) // (n * n)))

    n = len(x)
    if n < least:
        return [0], cost(0, n)
    best = {0: (-penalty, 0, ())}
    for j in range(least, n + 1):
        found = [(c + penalty + cost(i, j), k + 1, (i, *s)) for i, (c, k, s) in best.items() if j - i >= least]
        best[j] = min(found)
    return list(best[n][2])[::-1], best[n][0]


def series(r):
    n = r.randint(1, 45)
    level = [r.choice([0, 5, 50, 1000]) for _ in range(6)]
    x = [max(0, level[i * 6 // n] + r.randint(-3, 3) * r.choice([0, 1, 1, 5])) for i in range(n)]
    kind = r.random()
    return [r.choice([0, 1]) for _ in x] if kind < 0.2 else [7] * n if kind < 0.3 else [v * 10**12 for v in x] if kind < 0.4 else x


def test_segments_are_the_best_ones(monkeypatch):
    r = random.Random(1)
    for cells in (changepoints.CELLS, 60):
        monkeypatch.setattr(changepoints, "CELLS", cells)
        for _ in range(250):
            x = series(r)
            starts, _, cost, best = changepoints.segments(np.array(x, dtype=object))
            assert (starts, best) == plain_cuts(x)
            assert int(sum(cost)) + 20_000 * (len(starts) - 1) == best
    for _ in range(100):
        x = [r.choice([0, 9]) for _ in range(r.randint(3, 14))]
        starts, _, _, best = changepoints.segments(np.array(x), 2, 300)
        assert (starts, best) == plain_cuts(x, 2, 300)


def test_log_costs_are_those_of_the_library():
    v = np.array([[1, 2, 3, 10**6, 10**15, 2**53 + 1]], dtype=np.int64)
    assert changepoints.log_costs(np.full((1, 6), 3), v).tolist() == [[3 * math.floor(1000 * math.log(float(x))) for x in v[0].tolist()]]


def test_change_points_of_a_table(spark):
    r, day = random.Random(8), datetime(2024, 1, 30)
    rows, sums = [], defaultdict(Counter)
    for v in [*range(12), None]:
        for d, n in enumerate(series(r)):
            for part in {0: [], 1: [n], 2: [n, 0]}[r.choice([0, 1, 1, 2])]:
                part = part % 10**9
                rows.append((v, day + timedelta(days=d, hours=r.choice([0, 23])), part, "x", 1))
                sums[v][d] += part
    rows += [(3, None, 5, "x", 1), (3, day, None, "x", 1), (99, None, 1, "x", 1), (None, None, None, None, None)]
    schema = "vendor_id long, shipped_at timestamp_ntz, quantity int, d string, segment_no int"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).repartition(5).withColumn("vendor_id", F.col("vendor_id").cast("string"))):
        got = defaultdict(list)
        for x in changepoints.change_points(df).collect():
            got[x.vendor_id].append(x)
        assert len(got) == len(sums)
        for v, by in sums.items():
            first = min(by)
            x = [by[d] for d in range(first, max(by) + 1)]
            starts, best = plain_cuts(x)
            mine = sorted(got[v if v is None or isinstance(df.first().vendor_id, int) or df.schema["vendor_id"].dataType.typeName() == "long" else str(v)], key=lambda s: s.segment_no)
            zero = (day - datetime(1970, 1, 1)).days + first
            ends = [*starts[1:], len(x)]
            assert [(s.segment_no, s.first_day, s.n_days, s.total, s.n_segments, s.best_cost) for s in mine] == [(k + 1, zero + a, b - a, sum(x[a:b]), len(starts), best) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]
            assert sum(s.cost for s in mine) + 20_000 * (len(mine) - 1) == best
    assert changepoints.change_points(spark.createDataFrame([], schema)).collect() == []


# op13


def plain_words(rows):
    found = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        form = min(near, key=lambda x: (-words[x], x), default=None)
        form = form if form and words[form] >= 10 * n else None
        out[w] = [form, None, n, len(near), form and words[form]]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(row) for w, row in out.items()}


def test_near_rows_are_all_pairs_of_a_window():
    r = random.Random(3)
    for round_ in range(150):
        letters = r.choice(["ab", "abc", "abcdefgh\xe0\xff"])
        m = r.choice([2, 4, 7])
        lo = r.randint(0, m)
        hi = r.randint(lo + 1, m + 1)
        groups = [sorted({"".join(r.choice(letters) for _ in range(m + r.randint(0, 1))).encode("latin-1") for _ in range(r.randint(0, 40))}) for _ in range(r.randint(1, 3))]
        words = [w for g in groups for w in g]
        group = np.array([k for k, g in enumerate(groups) for _ in g], dtype=np.int64)
        same = lambda v: np.full(len(words), v)
        got = list(zip(*(x.tolist() for x in errata_trie.near_rows(words, group, same(m), same(lo), same(hi))), strict=True))
        want = []
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                part = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                if i != j and group[i] == group[j] and min(len(a), len(b)) == m and lo <= part < hi and one_edit(a, b):
                    want.append((i, j))
        assert sorted(got) == sorted(want), round_


@pytest.mark.parametrize("hot", [errata_trie.HOT_CHARS, 60])
def test_variants_of_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(errata_trie, "CHUNK_CHARS", 4000)
    r = random.Random(9)
    stems = ["".join(r.choice("aeinrst\xe9\xff") for _ in range(r.randint(6, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "b" * 3000, "b" * 3001]

    def word():
        w = r.choice(stems) if r.random() < 0.8 else stems[0]
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", "a", "x", w[k] * 2]) + w[k + r.choice([0, 1]) :]
        return w.capitalize() if r.random() < 0.2 else w

    rows = [(i, r.choice([" ", ", ", "1"]).join(word() for _ in range(30))) for i in range(120)] + [(None, "aaaaaaa Aaaaaaa \xc9aaaaaa \xd7\xf7aaaaaa" * 30), (7, None), (8, ""), (9, "short 123"), (9, "short 123")]
    rows += [(500 + k, "cabbage " * 10 + "cabbages " * (k % 10 == 0) + "cabbagens " * (k in (3, 4))) for k in range(300)]
    words = plain_words(rows)
    want = plain_variants(words)
    got = errata_trie.spelling_variants(odd_rows(spark, rows).repartition(3), hot_chars=hot).collect()
    assert {g.word: (g.form, g.root, g.n, g.n_near, g.form_n) for g in got} == want and len(got) == len(want)
    assert any(form and root != form for form, root, *_ in want.values())
    assert errata_trie.spelling_variants(odd_rows(spark, [])).collect() == []
