"""The corpus operators against plain versions of themselves, on odd rows, hot groups and every block size."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import bpe_tree, chat_hmm, licenses, minhash, multiset_hash, packing, random_indexing, repeats, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, __tj string, z string, score double, lead long"


def odd_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "x", "z", 0.5, 3) for i, t in rows], ODD)


# op1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_is_edit_distance(monkeypatch):
    r = random.Random(3)
    terms = {"".join(r.choice("abcd") for _ in range(r.randint(2, 11))) for _ in range(60)}
    for states in (100_000, 5):  # few states: the automaton is thrown away and made again
        monkeypatch.setattr(toxicity, "STATES", states)
        a = toxicity.Automaton(terms)
        for _ in range(600):
            w = "".join(r.choice("abcde") for _ in range(r.randint(0, 12))) if r.random() < 0.5 else toxicity.misspelt(r.choice(sorted(terms)), r.randint(0, 99))
            assert dict(a.hits(w)) == {t: distance(w, t) for t in terms if distance(w, t) <= toxicity.allowed(t)}
    m = toxicity.Model({t: float(i) for i, t in enumerate(sorted(terms), 1)}, {"abcabc"}, [0.0] * toxicity.Model.FEATURES)
    for _ in range(300):
        w = "".join(r.choice("abcd") for _ in range(r.randint(4, 10)))
        near = [(m.terms[t] * m.trust[t], distance(w, t)) for t in terms if distance(w, t) <= toxicity.allowed(t)]
        assert m.look(w) == ((m.terms[w], 0) if w in terms else None if w == "abcabc" else max(near, default=None))


def test_two_edits_in_long_terms():
    a = toxicity.Automaton(["grumbletoad", "scum"])
    assert a.hits("grmblet0ad") == (("grumbletoad", 2),) and a.hits("scm") == (("scum", 1),) and a.hits("scmm") == (("scum", 1),) and a.hits("cmm") == ()


# op2


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_fingerprints_by_any_id(spark, kind):
    r = random.Random(5)
    words = lambda: "\n".join(" ".join(f"w{r.randint(0, 99)}" for _ in range(12)) for _ in range(3))
    rows = [(i, words()) for i in range(25)] + [(None, words()) for _ in range(30)] + [(7, None), (7, "same"), (7, "same")]
    name = {"string": lambda i: f"doc-{i:03d}", "long": lambda i: i, "date": lambda i: f"2024-01-{i + 1:02d}"}[kind]
    df = spark.createDataFrame([(None if i is None else name(i), t) for i, t in rows], f"doc_id {'long' if kind == 'long' else 'string'}, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).hexdigest()))
    want = sorted((len(t), hashlib.sha256(multiset_hash.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (_, t) in enumerate(order))
    for parts in (1, 4):
        got = multiset_hash.fingerprint_documents(df, parts=parts).collect()
        assert sorted((x.n_chars, x.edited_sha256) for x in got) == want


# op3


def plain_states(e, odds):
    """Best path by keeping every state's whole best path (ties: the lower state before)."""
    paths = [((odds.start + e[0])[s], (s,)) for s in range(chat_hmm.STATES)]
    for row in e[1:]:
        step = []
        for s in range(chat_hmm.STATES):
            score, k = max(((paths[k][0] + odds.move[k, s]), -k) for k in range(chat_hmm.STATES))
            step.append((score + row[s], (*paths[-k][1], s)))
        paths = step
    return max(paths, key=lambda x: (x[0], -x[1][-1]))[1]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_every_role_at_every_block_size(spark, monkeypatch, parts):
    r = random.Random(13)
    rows = []
    for c in [*range(8), None]:
        for t in range(r.randint(1, 15)):
            mark = r.choice(["User: ", "Assistant: ", "### Human: ", "[AI] ", "", "", "System: "])
            rows.append((c, r.choice([t, t, None]) if c is None else t, mark + r.choice(["hello.", "why?\nand more", "", "list:\n- a\n\n- b", "x, y", "so it is.\n"]), f"tag{t}"))
    df = spark.createDataFrame([*rows, rows[0], rows[0]], "conv_id long, turn int, raw string, block string")
    lines = lambda c: sorted(((-1 if t is None else t), raw) for k, t, raw, _ in [*rows, rows[0], rows[0]] if k == c)
    found = chat_hmm.no_counts()
    chat_hmm.count_lines(((c, 0, i, raw) for c in [*range(8), None] for i, (_, raw) in enumerate(lines(c))), found)
    for fit in (False, True):
        odds, want = chat_hmm.Odds(found) if fit else chat_hmm.PLAIN, []
        for c in [*range(8), None]:
            flat = [x for _, raw in lines(c) for x in raw.split("\n")]
            e, texts = chat_hmm.emissions(flat, None, odds)
            states, at = plain_states(e, odds), 0
            for t, raw in lines(c):
                own = states[at : at + raw.count("\n") + 1]
                said = chat_hmm.turns(own, texts[at : at + len(own)])
                want.append((-1 if c is None else c, t, len(own), sum(s % 2 == 0 for s in own), chat_hmm.ROLES[own[0] // 2], own[0] % 2 == 0, "".join(chat_hmm.render(*x) for x in said)))
                at += len(own)
        # counts need one partition here: a pair of markers on two sides of a border between ranges isn't counted
        if fit and parts != "1":
            continue
        for n in (1, 3, 1024):
            monkeypatch.setattr(chat_hmm, "BLOCK_TURNS", n)
            old = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            try:
                got = chat_hmm.parse_blocks(df, fit=fit)
                assert got.columns == ["conv_id", "turn", "block", "n_lines", "n_turns", "parsed_role", "begins", "rendered"]
                assert sorted((-1 if x.conv_id is None else x.conv_id, -1 if x.turn is None else x.turn, x.n_lines, x.n_turns, x.parsed_role, x.begins, x.rendered) for x in got.collect()) == sorted(want)
            finally:
                spark.conf.set("spark.sql.shuffle.partitions", old)


def test_odds_are_counted(spark):
    rows = [(c, t, ("User: " if t % 2 else "Assistant: ") + "a.") for c in range(40) for t in range(6)]
    base = chat_hmm._blocks(spark.createDataFrame(rows, "conv_id long, turn int, raw string"))
    odds = chat_hmm._counts(base)
    a, u = 2 * chat_hmm.ROLES.index("assistant"), 2 * chat_hmm.ROLES.index("user")
    assert odds.move[a, u] > chat_hmm.MOVE[a, u] and np.exp(odds.move).sum(1) == pytest.approx(np.ones(chat_hmm.STATES))
    # no turn goes on here, so further lines are less likely than by the prior counts, and first lines are short
    assert odds.move[a, a + 1] < chat_hmm.MOVE[a, a + 1]
    assert odds.shape[2, a] > chat_hmm.PLAIN.shape[2, a] and odds.shape[9, a] < chat_hmm.PLAIN.shape[9, a]
    twice = spark.createDataFrame([(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None)], "conv_id long, turn int, role string, text string")
    assert chat_hmm.parse_blocks(chat_hmm.as_transcript(twice)).count() == 3


# op4


def plain_cover(texts, length):
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append(gone)
    return data, out


@pytest.mark.parametrize("block", [4096, 3])
def test_repeats_of_two_lengths(spark, block, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", block)
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(170))
    noise = lambda n: "".join(r.choice("ijklmnop ") for _ in range(n))
    texts = [noise(r.randint(0, 60)) + passage[r.randint(0, 60) :][: r.randint(50, 170)] + noise(r.randint(0, 60)) for _ in range(40)] + [passage, passage, None, "", "xy" * 120, "q" * 20_000, noise(30_000)]
    got = {x.doc_id: x for x in repeats.removed_digest(odd_rows(spark, enumerate(texts)), 100, 70).collect()}
    data, long = plain_cover(texts, 100)
    _, short = plain_cover(texts, 70)
    for i, b in enumerate(data):
        left = bytes(np.frombuffer(b, dtype=np.uint8)[~long[i]])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256, got[i].n_passage) == (len(b), int(long[i].sum()), hashlib.sha256(left).hexdigest(), int(short[i].sum()))


# op5


def plain_pack(lengths, capacity):
    sizes = packing.room_for(sum(lengths), capacity)
    whole = [s for s, n in enumerate(sizes) if n == capacity]
    left, cost, out, rest = dict(enumerate(sizes)), dict.fromkeys(range(len(sizes)), 0.0), [], []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity and whole:
            s = whole.pop(0)
            out.append((d, at, capacity, s))
            left[s], at = 0, at + capacity
        if n > at:
            rest.append((n - at, d, at))
    for n, d, at in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = [s for s in left if left[s] >= n]
        while n:
            s = min(fits, key=lambda s: (cost[s], s)) if fits else max(left, key=lambda s: (left[s], -s))
            k = min(n, left[s])
            out.append((d, at, k, s))
            left[s], cost[s], at, n = left[s] - k, cost[s] + packing.cost(k), at + k, n - k
    return out


def test_the_cheapest_sequence_with_room():
    r = random.Random(8)
    for _ in range(120):
        n = [r.choice([1, 3, 60, 64, 65, 200, r.randint(1, 90)]) for _ in range(r.randint(1, 300))]
        assert [x[:4] for x in packing.pack(n, 64)] == plain_pack(n, 64)


def test_packing_of_odd_rows_and_other_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "a b"), (None, "a b"), (1, None), (1, "the cat"), (1, "the cat"), (2, "x " * 9000)]
    got = packing.pack_documents(odd_rows(spark, rows), path).collect()
    coder = packing.WordCoder(path)
    assert sum(x.length for x in got) == sum(len(coder.lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('"Lowercase"', '"NFKC"', 1), encoding="utf-8")
    plain = packing.WordCoder(str(other))
    assert coder.fast and not plain.fast
    assert list(memoryview(plain.encode_packed(["The CAT"])[0]).cast("I")) == plain.lib.encode("The CAT", add_special_tokens=False).ids


# op6


def test_pieces_go_through_the_tree():
    coder = bpe_tree.TreeCoder.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(9)
    made = 0
    for _ in range(400):
        b = "".join(r.choice("etaoinshrdlu漢é0 ") for _ in range(r.randint(1, 60))).encode()
        before = coder.joins
        assert coder.encode_bytes(b) == ([coder.ranks[b]] if b in coder.ranks else coder.leaf(b))
        made += (coder.joins > before) == (b not in coder.ranks)
    assert made == 400  # every piece that is no token of its own
    assert bpe_tree.up_the_tree([bytes([i % 256]) for i in range(1000)]) == bytes(i % 256 for i in range(1000))
    other = bpe_tree.TreeCoder(coder.ranks, r"\S+|\s+")
    assert not other.spaced and other.decode_packed(other.encode_packed("a b  c\nd")) == b"a b  c\nd"


# op7


def test_licenses_against_every_window(spark):
    r = random.Random(10)
    templates = {"one": "alpha beta gamma delta epsilon zeta eta theta iota kappa", "two": "the red fox runs over green hills at dawn with four small dogs", "three": "all rights kept."}
    s = licenses.Scanner(templates)

    def plain(text, widths):
        a, out = licenses.words(text), set()
        for k, b in s.templates.items():
            if any(len(licenses.align(a[at : at + n], b)) >= s.least * len(b) for n in widths(k, len(b)) for at in range(len(a))):
                out.add(k)
        return out

    tight, any_width = lambda k, n: [n + s.spare[k]], lambda k, n: range(n - s.spare[k], 3 * n + 1)
    for _ in range(80):
        parts = []
        for _ in range(r.randint(0, 3)):
            w = r.choice(list(templates.values())).split()
            for _ in range(r.randint(0, 3)):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["zzz"], [w[i], "yyy"]])
                w = w or ["zzz"]
            parts += w + [r.choice(["pad", "alpha", "the", "kept"]) for _ in range(r.randint(0, 12))]
        text = " ".join(parts)
        found = {x[0] for x in s.all(text) if x[0]}
        assert plain(text, tight) <= found <= plain(text, any_width)
    long = "word " * 200_000 + templates["one"] + " word" * 1000
    got = licenses.scan_licenses(odd_rows(spark, [(1, long), (None, None), (2, ""), (2, "")]), templates).collect()
    assert sorted((x.doc_id or 0, x.license, x.coverage) for x in got) == [(0, None, 0.0), (1, "one", 1.0), (2, None, 0.0), (2, None, 0.0)]


# op8


def test_pooling_against_plain_counts():
    texts = ["Good good words here.\nGood good words here.\nBAD 12", "", "a b a b c", "one two three four five\none two three four five"]
    run = [t.encode() for t in texts]
    h, *_ = random_indexing.tokens(run)
    vocab = np.unique(h)[:8]
    vectors = np.random.default_rng(1).normal(size=(random_indexing.COLUMNS, random_indexing.DIM)).astype(np.float32)
    got = random_indexing.pool(run, vocab, vectors)
    for i, t in enumerate(run):
        hh, kind, size, caps, _, again, _, line_size = random_indexing.tokens([t])
        ids = [int(np.searchsorted(vocab, x)) if x in vocab else random_indexing.VOCAB + (int(k) - 1) * 16 + min(int(z), 15) for x, k, z in zip(hh, kind, size, strict=True)]
        counts = np.zeros(random_indexing.COLUMNS)
        for x in ids:
            counts[x] += 1
        total = max(counts.sum(), 1)
        mark = random_indexing.VOCAB + random_indexing.SHAPES
        counts[mark : mark + 3] = caps.sum(), len(again), line_size.sum()
        seen = counts > 0
        want = np.concatenate([counts @ vectors / total, seen @ vectors / max(seen.sum(), 1)])
        assert np.allclose(got[i], want, atol=1e-5)
    m = random_indexing.Model.load(random_indexing.fit(["good words here", "bad bad bad"] * 30, [1, 0] * 30))
    alone = [float(m.scores([t])[0]) for t in texts]
    assert np.allclose(m.scores(texts), alone) and all(0 <= x <= 1 for x in alone)


# op10


def components_of(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [6 << 20, 4000])
def test_a_long_chain_of_near_copies(spark, block, monkeypatch):
    """Neighbours are linked and ends are not: with small blocks the lead isn't linked with most of its group."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):
        rows.append((i, " ".join(words)))
        if i % 9 == 8:  # a jump that breaks the chain for some
            for _ in range(6):
                words[r.randrange(60)] = f"j{r.randint(0, 999)}"
        words[(i * 7) % 60] = f"v{i}"
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    want = components_of(sets, 85)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(odd_rows(spark, rows), 3, 85).collect()}
    assert [got[i] for i in range(len(rows))] == want and 1 < len(set(want)) < len(rows)


@pytest.mark.parametrize("percent", [50, 80, 85])
@pytest.mark.parametrize("cross", [False, True])
def test_forest_of_many_sets_ties_what_all_pairs_tie(percent, cross):
    """Hundreds of sets with a common core: links at, over and just under the threshold, none lost to the prefixes."""
    r = random.Random(percent + cross)
    core = [r.getrandbits(60) for _ in range(12)]
    sets = []
    for _ in range(90):
        base = core + [r.getrandbits(60) for _ in range(r.choice([8, 28, 88]))]
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, len(own) // r.choice([5, 12, 30]))):
                own[r.randrange(len(own))] = r.getrandbits(60)
            sets.append(np.unique(np.array(own[: r.choice([len(own), len(own), 9 * len(own) // 10])], dtype=np.uint64)))
    r.shuffle(sets)
    n = len(sets)
    sides = np.array([0] * (n // 2) + [1] * (n - n // 2)) if cross else np.zeros(n, dtype=int)
    links, root = minhash.forest(np.arange(n), sides, sets, percent)
    want = list(range(n))
    plain = [set(x.tolist()) for x in sets]

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    linked = set()
    for i in range(n):
        for j in range(i + 1, n):
            if (not cross or sides[i] != sides[j]) and 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j]):
                linked.add((i, j))
                a, b = find(i), find(j)
                want[max(a, b)] = min(a, b)
    assert len(linked) > 60 and set(links) <= linked
    assert root.tolist() == [find(i) for i in range(n)]


def test_forest_across_sides():
    r = random.Random(12)
    sets = [np.unique(np.array([r.randint(0, 40) for _ in range(30)], dtype=np.uint64)) for _ in range(30)]
    sides = np.array([0] * 12 + [1] * 18)
    links, _ = minhash.forest(np.arange(30), sides, sets, 50)
    full = {(i, j) for i in range(12) for j in range(12, 30) if 100 * len(set(sets[i]) & set(sets[j])) >= 50 * len(set(sets[i]) | set(sets[j]))}
    assert set(links) <= full
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in full)


# stages


def test_stages_on_odd_tables(spark):
    import corpus_pipeline as P

    texts = [(1, None), (2, ""), (3, " \n"), (None, "null id text of several words"), (4, "w " * 40_000), (5, "same words in two rows"), (5, "same words in two rows")]
    docs = odd_rows(spark, texts)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        none = stage(spark, docs.limit(0), SF)
        if name == "packing":
            assert none.count() == 0 and {x.doc_id for x in out.select("doc_id").distinct().collect()} == {1, 2, 3, 4, 5, None}
            continue
        assert out.columns == docs.columns and none.count() == 0 and none.columns == docs.columns
        rows = [(x.doc_id, x.text) for x in out.collect()]
        if name == "near_dedup":
            assert sorted((i or 0) for i, _ in rows) == [0, 1, 2, 3, 4, 5]
        elif name == "repeats":
            assert len(rows) == len(texts) and (1, None) in rows and (5, "same words in two rows") in rows
            assert next(len(t) for i, t in rows if i == 4) < 400
        elif name == "toxicity":
            assert len(rows) == len(texts)
        assert all(re.fullmatch(r"k", x.key) for x in out.select("key").collect())
