"""Spelling variants: words one edit apart, by merging the light subtrees of tries of words.

Two words differ by one inserted, deleted or replaced code point exactly if,
below the node where their paths part, one is found again when the character
there is skipped or replaced.  So at every branching node of a trie the words of
the *light* children (all but the largest) are merged, with that character
skipped or replaced, with one another and with the heavy child: light ones meet
where they end at the same remaining path, and the heavy child is only looked
up, never walked.  A word is light at most log2(words) times (small to large).

Tries are made of words that must share all but a window of positions: a word
of length L goes, for the shorter length m = L and m = L - 1 of a pair, to one
trie for each window [lo, hi) of the places where paths can part, keyed by what
lies outside the window.  A pair parts in one window alone, so it is found once.
A key with too many words is split into narrower windows; one of width 1 leaves
two characters open at most.  Nodes are runs of the sorted words of a task, so
all tries of a task are walked level by level with whole-array operations; hashes
nominate and the characters themselves decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm import bytesx as B
from trajecta.llm.tables import cut, discard
from trajecta.ship import ship

# Letters of a word, and those that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, EVERY, RATIO = 7, 2, 31, 10
#: Characters of the words of one key, above which it is split.
HOT_CHARS = 1 << 21
#: Characters of the words that a task walks at once (a key is never parted).
CHUNK_CHARS = 1 << 20
_CODE = B.BYTE.copy()
_CODE[0] = 0


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``every`` of them with a character deleted, counted."""
    run = F.col("run")
    runs = docs.select(F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs[text], F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: a hash of what lies outside the window [lo, hi) of a pair whose shorter word has m characters."""
    size, tail = F.length("word"), F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    outside = F.substring("word", F.lit(1), F.col("lo")), F.when(tail > 0, F.substring(F.col("word"), size - tail + 1, tail)).otherwise("")
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", *outside))


def _first_windows(words: DataFrame, least_length: int) -> DataFrame:
    """Two windows for each word and each shorter length of a pair that it can be in."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= least_length)
    mid = F.floor((F.col("m") + 1) / 2).cast("int")
    ends = F.array(F.struct(F.lit(0).alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), (F.col("m") + 1).alias("hi")))
    return _keyed(rows.select("word", "n", "m", F.explode(ends).alias("w")).select("word", "n", "m", "w.lo", "w.hi"))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    ends = F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))
    return _keyed(rows.select("word", "n", "m", F.explode(ends).alias("w")).select("word", "n", "m", "w.lo", "w.hi"))


def _equal(a: np.ndarray, rows: np.ndarray, others: np.ndarray, shift: int, d: int) -> np.ndarray:
    """Whether rows of ``a``, with the character at d replaced (shift 0) or skipped (shift 1), are the other rows."""
    out = np.zeros(len(rows), dtype=bool)
    step = max(1, (1 << 22) // a.shape[1])
    for k in range(0, len(rows), step):
        x, y = a[rows[k : k + step]], a[others[k : k + step]]
        same = (x[:, :d] == y[:, :d]).all(axis=1)
        same &= (x[:, d + 1 :] == y[:, d + 1 :]).all(axis=1) if not shift else (x[:, d + 1 :] == y[:, d:-1]).all(axis=1)
        out[k : k + step] = same
    return out


def near_rows(words: list[bytes], group: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both directions of all near pairs (row, row) whose paths part inside their group's window.

    Groups follow one another, and the distinct words of a group are sorted.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(words) < 2:
        return none, none
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = int(size.max()) + 2
    a = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    up, down = B.powers(width + 2)
    sums = np.zeros((len(words), width + 1), dtype=np.uint64)
    np.cumsum(_CODE[a] * up[:width], axis=1, out=sums[:, 1:])
    whole = sums[np.arange(len(words)), size]
    salt = B.mix(group.astype(np.uint64) + B.U(1))
    order = np.argsort(B.mix(whole ^ salt))
    table = B.mix(whole ^ salt)[order]
    #: Characters that a row shares with the row above; -1 for the first of a group.
    shared = np.full(len(words), -1, dtype=np.int64)
    kin = group[1:] == group[:-1]
    shared[1:][kin] = (a[1:] != a[:-1]).argmax(axis=1)[kin]
    pairs: list[np.ndarray] = []

    def put(rows, others, shift, d):
        keep = _equal(a, rows, others, shift, d)
        pairs.append(np.stack([rows[keep], others[keep]]))

    def look_up(rows, hashes, shift_from_other, d, shift):
        """Rows whose wanted word is in their group."""
        wanted = B.mix(hashes ^ salt[rows])
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        hit = table[at] == wanted
        rows, others = rows[hit], order[at[hit]]
        if shift_from_other:
            rows, others = others, rows
        put(rows, others, shift, d)

    parted = shared[(shared >= lo) & (shared < hi)]
    for d in np.unique(parted).tolist():
        node = np.cumsum(shared < d)
        child = np.cumsum(shared <= d)
        branching = np.zeros(int(node[-1]) + 1, dtype=bool)
        branching[node[(shared == d) & (lo <= d) & (d < hi)]] = True
        rows = np.flatnonzero(branching[node])
        first = np.flatnonzero(np.r_[True, child[rows][1:] != child[rows][:-1]])
        count = np.diff(np.r_[first, len(rows)])
        of = node[rows[first]]
        by_size = np.lexsort((-count, of))
        heavy = by_size[np.r_[True, of[by_size][1:] != of[by_size][:-1]]]
        letter = np.zeros(len(branching), dtype=np.uint8)
        letter[of[heavy]] = a[rows[first[heavy]], d]
        is_heavy = np.zeros(len(first), dtype=bool)
        is_heavy[heavy] = True
        light = rows[~np.repeat(is_heavy, count)]
        size_l, m_l, own = size[light], m[light], letter[node[light]]
        head, rest, past = sums[light, d], whole[light] - sums[light, d], whole[light] - sums[light, min(d + 1, width)]
        step = _CODE[own] * up[d]
        equal = (size_l == m_l) & (size_l > d)
        some = equal & (own > 0)
        look_up(light[some], (head + step + past)[some], False, d, 0)  # the character replaced by the heavy one
        some = (size_l == m_l) & (own > 0)
        look_up(light[some], (head + step + rest * B.BASE)[some], True, d, 1)  # the heavy one skipped
        some = (size_l == m_l + 1) & (a[light, d] != a[light, min(d + 1, width - 1)])
        look_up(light[some], (head + past * B.BASE_INV)[some], False, d, 1)  # the light one skipped
        meet, end = light[equal], B.mix(past[equal]) ^ B.mix(node[light[equal]].astype(np.uint64))
        at = np.argsort(end, kind="stable")
        meet, end = meet[at], end[at]
        k = 1
        while k < len(end) and (same := end[k:] == end[:-k]).any():  # light ones that end at the same path
            put(meet[:-k][same], meet[k:][same], 0, d)
            k += 1
    if not pairs:
        return none, none
    x, y = np.concatenate(pairs, axis=1)
    return np.concatenate([x, y]), np.concatenate([y, x])


def _chunks(batches):
    """Rows (word, n, m, lo, hi, key) in runs of whole keys."""
    import pyarrow as pa

    held, chars = [], 0
    for b in batches:
        held.append(b)
        chars += b.column(0).nbytes
        if chars >= CHUNK_CHARS:
            t = pa.Table.from_batches(held).combine_chunks()
            cols = [t.column(c).to_numpy() for c in ("key", "m", "lo", "hi")]
            other = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
            if len(other):
                yield t.slice(0, int(other[-1]) + 1)
                t = t.slice(int(other[-1]) + 1)
            held, chars = t.to_batches(), sum(x.column(0).nbytes for x in t.to_batches())
            if not len(other):
                chars = -chars  # a key that goes on: twice as much before the next look
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _walked(keyed: DataFrame) -> DataFrame:
    """(word, near, best): near words within the tries of a task, and (-n, word) of the most frequent one."""

    def run(batches):
        import pyarrow as pa

        for t in _chunks(batches):
            names = t.column("word").to_pylist()
            key, m, lo, hi, n = (t.column(c).to_numpy() for c in ("key", "m", "lo", "hi", "n"))
            new = np.r_[True, (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            x, y = near_rows([w.encode("latin-1") for w in names], np.cumsum(new), m, lo, hi)
            if not len(x):
                continue
            order = np.lexsort((y, -n[y], x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            near = np.diff(np.r_[first, len(x)])
            word = pa.array([names[i] for i in x[first].tolist()], pa.string())
            best = pa.array([names[i] for i in y[first].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([word, pa.array(near), pa.array(n[y[first]]), best], names=["word", "near", "best_n", "best"])

    at = ["m", "lo", "hi", "key"]
    parted = keyed.select("word", "n", *at).repartition(*at).sortWithinPartitions(*at, "word")
    return parted.mapInArrow(run, "word string, near long, best_n long, best string")


def _forms(words: DataFrame, least_length: int, hot_chars: int) -> DataFrame:
    """(word, n_near, best_n, best) of all words that have near words."""
    found, todo, spent = None, _first_windows(words, least_length), []
    while True:
        key = ["m", "lo", "hi", "key"]
        hot = cut(todo.groupBy(*key).agg(F.sum(F.length("word")).alias("chars")).where((F.col("chars") > hot_chars) & (F.col("hi") - F.col("lo") > 1)).select(*key))
        spent.append(hot)
        more = not hot.isEmpty()
        part = _walked(todo.join(hot, key, "left_anti") if more else todo)
        found = part if found is None else found.union(part)
        if not more:
            break
        todo = cut(_halved(todo.join(hot, key, "left_semi")))
        spent.append(todo)
    best = F.min(F.struct((-F.col("best_n")).alias("best_n"), "best"))
    out = cut(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.best_n")).alias("best_n"), "b.best"))
    discard(*spent)
    return out


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, ratio: int = RATIO, hot_chars: int = HOT_CHARS) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words, and very long texts and words are taken
    whole.  A null doc_id counts as an empty one where occurrences are chosen.
    Repeated rows count as often as they stand there.  Of near words with equal
    counts the first in code-point order is the form.  An empty table gives no
    rows; other columns are not read.  Counts rise by ``ratio`` along forms, so
    a chain has at most 18 steps for ratio 10, and five doublings end it.
    """
    ship(docs.sparkSession)
    words = cut(word_counts(docs, doc_id, text, least_length, least_count, every))
    near = _forms(words, least_length, hot_chars)
    formed = F.col("best_n") >= ratio * F.col("n")
    out = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    discard(near, words)
    step = out.where("form is not null").select("word", F.col("form").alias("root"))
    reach = 1
    while (max(ratio, 2) ** reach) < 1 << 63:  # a chain's steps are fewer
        to = step.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = cut(step.join(to, step.root == to.at, "left").select("word", F.coalesce("to", "root").alias("root")))
        reach *= 2
    return out.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
