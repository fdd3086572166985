"""Classifiers, transcripts, near copies, vectors and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import trajecta.llm.queries as Q
from trajecta.llm import chat_hmm, labelled, minhash, minhash_core, pivots, random_indexing, tables, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, cluster long, sig string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "x") for i, t in rows], SCHEMA)


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*[w[k:] for k in range(n)]))


def plain_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def near_rows():
    r = random.Random(8)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE two")]
    for g in range(25):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, "same text of several words here") for k in range(5)]
    return rows


@pytest.mark.parametrize("block", [6 << 20, 6000])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    rows = near_rows()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == plain_components(rows, 3, 85)


def test_keep_one_and_odd_tables(spark):
    rows = near_rows()
    kept = minhash.keep_one(frame(spark, rows), 5, 80)
    want = {d for d, (_, c) in plain_components(rows, 5, 80).items() if d == c}
    assert kept.columns == frame(spark, []).columns and sorted(x.doc_id for x in kept.collect()) == sorted(want)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0 and minhash.keep_one(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)])
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in minhash.near_duplicates(twice).collect())
    assert got == [(-1, -1, False), (-1, 1, False), (1, 1, True), (1, 1, True)]
    assert sorted(x.doc_id or -1 for x in minhash.keep_one(twice).collect()) == [-1, -1, 1]


def test_keep_one_decides_by_row(spark):
    copy = " ".join(f"w{i}" for i in range(60))
    rows = [(5, "zz yy xx vv uu tt ss"), (5, copy + " end"), (3, copy), (7, ""), (7, "aa bb cc dd ee ff"), (8, "pp qq rr ss tt uu"), (8, "pp qq rr ss tt uu")]
    for a in (rows, [(d, "qq " * 3 + x if x.startswith("zz") else x) for d, x in rows]):
        got = sorted((x.doc_id, x.text) for x in minhash.keep_one(frame(spark, a), 5, 80).collect())
        assert got == sorted([a[0], a[2], a[3], a[4], a[5]])


def test_signature_estimates_likeness():
    r = np.random.default_rng(9)
    x = r.integers(0, 1 << 62, 2000, dtype=np.uint64)
    sets = np.concatenate([np.sort(x[:1000]), np.sort(x[100:1100])])
    s = minhash_core.signatures(sets, np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.2


def test_components(spark):
    r = random.Random(5)
    for edges in ([], [(i, i + 1) for i in range(200)], [(r.randint(0, 300), r.randint(0, 300)) for _ in range(250)]):
        got = {x.node: x.root for x in tables.components(spark.createDataFrame([*edges, (1, 1), (None, 2)], "a long, b long")).collect()}
        root = {}

        def find(v):
            root.setdefault(v, v)
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            if a != b:
                root[find(a)] = find(b)
        assert len(got) == len(root) and len({(find(v), got[v]) for v in root}) == len({find(v) for v in root}) == len(set(got.values()))


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", block)
    r = np.random.default_rng(10)
    x = [r.normal(size=16) for _ in range(120)]
    for k in range(60):
        x.append(x[k % 6] + r.normal(size=16) * 0.02 * np.linalg.norm(x[k % 6]) / 4)
    x += [x[0], x[0], x[1] * 3]
    rows = [(i, [float(c) for c in v], i % 2 if i >= 120 else 0) for i, v in enumerate(x)]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [float("nan")] + [1.0] * 15, 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (None, rows[3][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = {g.vec_id: g for g in pivots.near_vectors(df).collect()}
    u = np.array([v / np.linalg.norm(v) for v in x])
    lab = np.array([t[2] for t in rows])
    near = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :])
    want = near.sum(1) - 1
    want[3] += 1  # the row without an id
    for j in np.flatnonzero(near[3]):
        want[j] += j != 3
    have = np.array([got[i].n_links for i in range(len(rows))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    for i in (900, 901, 902, 903, 904, 905, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].kept is False and got[0].component_id == 0
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_vector_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    u = np.stack(df.embedding).astype(float)
    noise = np.random.default_rng(1).normal(size=u.shape) * 0.018
    both = np.concatenate([u, u + noise * np.linalg.norm(u, axis=1, keepdims=True)])
    lab = np.concatenate([df.label, df.label])
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(both, lab, strict=True))]
    got = sum(x.n_links for x in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    w = both / np.linalg.norm(both, axis=1, keepdims=True)
    want = int((((w @ w.T) >= 0.98) & (lab[:, None] == lab[None, :])).sum()) - len(w)
    assert want > 1000 and 0.9 * want <= got <= want


def folds(ids):
    return np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in ids])


@pytest.mark.parametrize(("mod", "label", "least"), [(random_indexing, "quality", 0.97), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, mod, label, least):
    d = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = mod.classify(docs, lab).join(lab, "doc_id").toPandas()
    assert (got.held_out.to_numpy() == folds(got.doc_id)).all() and got.score.between(0, 1).all()
    test = got[got.held_out]
    assert (test.predicted == test[label]).mean() >= least


@pytest.mark.parametrize(("mod", "label"), [(random_indexing, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_one_label(spark, mod, label):
    docs = frame(spark, [(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000), (None, "a b")])
    for labels in ([], [(1, 1, 1), (2, 1, 1), (None, 0, 0), (3, None, None)], [(i, i % 2, i % 2) for i in range(5)]):
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
        got = mod.classify(docs, lab)
        assert got.count() == 5 and got.where("score is null or isnan(score)").count() == 0
    assert mod.classify(docs.limit(0), lab).count() == 0


def test_toxicity_finds_misspellings_and_spares_quotation():
    r = random.Random(11)
    clean = lambda n: " ".join("".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [clean(60) for _ in range(400)] + [f"{clean(20)} grumbletoad {clean(9)} wretchling {clean(20)}" for _ in range(60)]
    m = toxicity.Model.load(toxicity.fit(texts, [0] * 400 + [1] * 60))
    assert {"grumbletoad", "wretchling"} <= set(m.terms)
    plain, bad, missp, quoted = m.scores([clean(60), f"{clean(20)} grumbletoad and wretchling {clean(20)}", f"{clean(20)} grumblet0ad you wretchlng {clean(20)}", f'{clean(20)} he said "grumbletoad" {clean(20)}'])
    assert bad > 0.5 > plain and missp > 0.5 and quoted < bad
    walk = {t: e for t, e in toxicity.Trie(["cat", "cart", "dog"]).walk("cat")}
    assert walk == {"cat": 0, "cart": 1}


def test_levenshtein_walk_is_exact():
    r = random.Random(12)

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    terms = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(60)}
    trie = toxicity.Trie(terms)
    for _ in range(200):
        w = "".join(r.choice("abc") for _ in range(r.randint(0, 6)))
        for k in (0, 1, 2):
            assert dict(trie.walk(w, k)) == {t: dist(w, t) for t in terms if dist(w, t) <= k}
        assert trie.near(w) or not trie.walk(w, 1)


def test_labels_are_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    lab = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    n = labelled.training_rows(docs, lab, "toxic", bound=500).count()
    assert 400 < n < 600


def test_chat_blocks_equal_the_plain_parse(spark, monkeypatch):
    monkeypatch.setattr(chat_hmm, "BLOCK_TURNS", 4)
    r = random.Random(13)
    rows = []
    for c in range(6):
        for t in range(r.randint(1, 15)):
            mark = r.choice(["User: ", "Assistant: ", "### Human: ", "[AI] ", "", "System: "])
            rows.append((c, t, mark + r.choice(["hello.", "why?\nand more", "", "list:\n- a\n- b"])))
    df = spark.createDataFrame(rows, "conv_id long, turn int, raw string")
    got = {(x.conv_id, x.turn): x for x in chat_hmm.parse_blocks(df).collect()}
    for c in range(6):
        own = [(t, raw) for k, t, raw in rows if k == c]
        e, _ = chat_hmm.emissions("\n".join(raw for _, raw in own).split("\n"), None)
        lines = [x for _, raw in own for x in raw.split("\n")]
        assert len(e) == len(lines)
        assert sum(got[c, t].n_lines for t, _ in own) == len(lines)
    assert chat_hmm.parse("User: hi\nAssistant: yes\nand more") == [("user", "hi"), ("assistant", "yes\nand more")]
    assert chat_hmm.parse("") == []
    odd = spark.createDataFrame([(None, None, None), (1, None, ""), (1, 0, "User: a"), (1, 0, "User: a")], "conv_id long, turn int, raw string")
    assert chat_hmm.parse_blocks(odd).count() == 4 and chat_hmm.parse_blocks(odd.limit(0)).count() == 0


def test_viterbi_by_blocks_is_viterbi():
    r = np.random.default_rng(14)
    e = np.log(r.random((40, chat_hmm.STATES)) + 1e-3)
    whole = chat_hmm.viterbi(e, None, None)
    parts = [e[:7], e[7:20], e[20:]]
    head = (chat_hmm.START + parts[0][0])[:, None] + chat_hmm.transfer(parts[0][1:])
    mats = [((chat_hmm.MOVE + p[0][None])[:, :, None] + chat_hmm.transfer(p[1:])[None]).max(1) for p in parts[1:]]
    ends = chat_hmm.borders(head.max(0), mats)
    got = [s for k, p in enumerate(parts) for s in chat_hmm.viterbi(p, ends[k - 1] if k else None, ends[k])]
    assert got == whole


def test_roles_of_the_table(spark):
    got = Q.op3_chat_hmm(spark, SF).toPandas()
    marked = got[got.marked]
    assert (marked.parsed_role == marked.role.fillna("user")).all() and marked.begins.all()


def test_unmarked_turns_are_recovered(spark, monkeypatch):
    got = Q.op3_chat_hmm(spark, "/root/testdata/sf0.1").where("not marked").toPandas()
    right = (got.parsed_role == got.role.fillna("user")) & got.begins
    blank, newline = right[got.layout == "blank"], right[got.layout == "newline"]
    # without a blank line nothing but lengths and the next marker tells where in these made-up texts a turn begins
    assert len(blank) > 100 and blank.mean() > 0.9 and len(newline) > 100 and newline.mean() > 0.25
    # a marker always begins a turn, also an unlikely one; unmarked lines in a plain transcript can begin one
    assert [r for r, _ in chat_hmm.parse("User: a.\nAssistant: b.\nSystem: c.\nUser: d.\nUser: e.")] == ["user", "assistant", "system", "user", "user"]
    assert chat_hmm.parse("User: a?\n\nb it is.\nUser: c.") == [("user", "a?"), ("assistant", "b it is."), ("user", "c.")]
    assert chat_hmm.parse("User: a?\nAssistant: b.\n\nmore b.\nUser-friendly c.\nUser: d.") == [("user", "a?"), ("assistant", "b.\n\nmore b.\nUser-friendly c."), ("user", "d.")]
    # the same however the conversation is cut into blocks
    rows = [(1, t, ("User: " if t % 2 == 0 else "AI: ") * (t % 3 != 2) + "one, two\nthree.") for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, raw string")
    for n in (1, 3, 1024):
        monkeypatch.setattr(chat_hmm, "BLOCK_TURNS", n)
        got = [(x.parsed_role, x.n_turns) for x in sorted(chat_hmm.parse_blocks(df).collect(), key=lambda x: x.turn)]
        # the last turn has no marker and none after it, so it goes on with the one before
        assert got == [*((("user", "assistant")[t % 2], 1) for t in range(11)), ("user", 0)]


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = tables.cut(stage(spark, kept, SF))
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        if name == "near_dedup":
            rows = [(x.doc_id, x.text) for x in kept.collect()]
            want = {d for d, (_, c) in plain_components(rows, 5, 80).items() if d == c}
            assert {x.doc_id for x in out.collect()} == want
        else:
            assert out.count() <= kept.count()
        kept = out
    assert 0 < kept.count() < docs.count() and lab.count()
    last = Counter()
    for x in P.run(spark, SF).collect():
        last[x.doc_id] += x.length
    assert set(last) == {x.doc_id for x in kept.collect()}
