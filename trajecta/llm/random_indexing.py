"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every token has a sparse random index vector made from its hash.  Its word
vector is its own index vector plus those of its neighbours in the fitted
sample (two on either side), scaled to length one.  A document is the mean of
its tokens' vectors beside the mean over its distinct tokens.  A network with
one hidden layer gives the logit, and a temperature fitted on held-back
training rows calibrates it.

Tokens are runs of letters, digits or other marks and line ends; words written
in capitals, words repeated within two places and repeated lines add a mark of
their own.  Tokens outside the vocabulary share vectors by kind and length.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trajecta.llm import bytesx as B
from trajecta.llm.labelled import SAMPLE_ROWS, fit_in_task, held_out, training_rows
from trajecta.ship import ship

DIM, NONZERO, VOCAB, WINDOW, HIDDEN = 96, 6, 4096, 2, 32
SHAPES = 64
MARKS = 3  # capitals, repeated word, repeated line
COLUMNS = VOCAB + SHAPES + MARKS

_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[128:] = 1
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[10] = 3


def tokens(run: list[bytes]) -> tuple[np.ndarray, ...]:
    """Hash, kind, length, capitals flag and owner of all tokens, and (owner, mark) of the marks."""
    buf, starts, _ = B.lay(run, b" ")
    kind = _KIND[buf]
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 3)]))
    stop = np.append(edge[1:], len(buf))
    keep = kind[edge] != 0
    s, e = edge[keep], stop[keep]
    low = B.LOWER[buf]
    up = np.concatenate([[0], np.cumsum(low != buf)])
    down = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
    h = B.span_hash(B.prefix_hash(low), s, e)
    owner = np.searchsorted(starts, s, "right") - 1
    k, size = kind[s], e - s
    caps = (k == 1) & (up[e] - up[s] >= 2) & (down[e] - down[s] == 0)
    # repeated words, among words alone
    w = np.flatnonzero(k == 1)
    again = np.zeros(len(w), dtype=bool)
    for d in (1, 2):
        again[d:] |= (h[w[d:]] == h[w[:-d]]) & (owner[w[d:]] == owner[w[:-d]])
    # repeated lines of five tokens at least
    line = np.cumsum(k == 3) + owner
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])) if len(s) else np.zeros(0, dtype=np.int64)
    lo, ln = owner[first], np.diff(np.append(first, len(s)))
    lh = np.add.reduceat(B.mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(first, ln).astype(np.uint64)), first) if len(s) else h
    long = ln >= 5
    lo, lh, ln = lo[long], lh[long], ln[long]
    order = np.lexsort((lh, lo))
    same = np.zeros(len(lo), dtype=bool)
    same[1:] = (lo[order][1:] == lo[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    rep = order[same]
    return h, k, size, caps, owner, w[again], lo[rep], ln[rep]


class Model:
    """Fitted arrays: vocabulary hashes, word vectors, scaling, two layers and the temperature."""

    NAMES = ("vocab", "vectors", "mean", "scale", "w1", "b1", "w2", "b2", "temperature")

    def __init__(self, **arrays):
        for n in self.NAMES:
            setattr(self, n, arrays[n])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, b: bytes) -> Model:
        return cls(**np.load(io.BytesIO(b)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return (hidden @ self.w2 + self.b2).ravel()

    def scores(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        for first, run in B.slices(texts):
            x = pool(run, self.vocab, self.vectors)
            out[first : first + len(run)] = 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))
        return out


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Sparse rows of +1 and -1 from hashes."""
    out = np.zeros((len(keys), DIM), dtype=np.float32)
    for k in range(NONZERO):
        m = B.mix(keys ^ B.U((k + 1) * 0x9E3779B97F4A7C1 % (1 << 64)))
        np.add.at(out, (np.arange(len(keys)), (m % B.U(DIM)).astype(np.int64)), np.where(m >> B.U(63), 1.0, -1.0))
    return out


def _ids(h, kind, size, vocab) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1) if len(vocab) else np.zeros(len(h), dtype=np.int64)
    known = vocab[at] == h if len(vocab) else np.zeros(len(h), dtype=bool)
    shape = VOCAB + (kind.astype(np.int64) - 1) * 16 + np.minimum(size, 15)
    return np.where(known, at, shape)


def pool(run: list[bytes], vocab: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean over tokens beside the mean over distinct tokens; zero rows for texts without tokens."""
    h, kind, size, caps, owner, again, line_owner, line_size = tokens(run)
    n = len(run)
    counts = np.bincount(owner * COLUMNS + _ids(h, kind, size, vocab), minlength=n * COLUMNS).reshape(n, COLUMNS).astype(np.float32)
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    mark = VOCAB + SHAPES
    counts[:, mark] = np.bincount(owner[caps], minlength=n)
    counts[:, mark + 1] = np.bincount(owner[again], minlength=n)
    counts[:, mark + 2] = np.bincount(line_owner, weights=line_size, minlength=n)
    seen = (counts > 0).astype(np.float32)
    return np.hstack([counts @ vectors / total, seen @ vectors / np.maximum(seen.sum(1, keepdims=True), 1)]).astype(np.float64)


def word_vectors(runs: list[list[bytes]], vocab: np.ndarray) -> np.ndarray:
    keys = np.concatenate([np.pad(vocab, (0, VOCAB - len(vocab))), B.mix(np.arange(SHAPES + MARKS, dtype=np.uint64))])
    own = index_vectors(keys)
    total = np.zeros_like(own)
    for run in runs:
        h, kind, size, _, owner, *_ = tokens(run)
        ids = _ids(h, kind, size, vocab)
        for d in range(1, WINDOW + 1):
            near = owner[d:] == owner[:-d]
            a, b = ids[d:][near], ids[:-d][near]
            for x, y in ((a, b), (b, a)):
                order = np.argsort(x, kind="stable")
                x, y = x[order], y[order]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else []
                if len(first):
                    total[x[first]] += np.add.reduceat(own[y], first, axis=0)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    v = own / np.sqrt(NONZERO) + total / np.where(length == 0, 1, length)
    v[VOCAB + SHAPES :] = 2 * own[VOCAB + SHAPES :] / np.sqrt(NONZERO)
    return (v / np.linalg.norm(v, axis=1, keepdims=True).clip(1e-9)).astype(np.float32)


def _train(x, y, hidden, steps, seed):
    """Adam on the cross entropy with weight decay."""
    r = np.random.Generator(np.random.PCG64(seed))
    p = [r.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, np.sqrt(2 / hidden), (hidden, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        pick = r.integers(0, len(x), min(256, len(x)))
        a, b = x[pick], y[pick][:, None]
        z = a @ p[0] + p[1]
        hid = np.maximum(z, 0)
        g = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -40, 40))) - b) / len(a)
        gh = (g @ p[2].T) * (z > 0)
        grads = [a.T @ gh + 1e-4 * p[0], gh.sum(0), hid.T @ g + 1e-4 * p[2], g.sum(0)]
        rate = 3e-3 * (1 - t / (steps + 1))
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p


def fit(texts: list, ys: list) -> bytes:
    """Model from texts and 0/1 labels.  Without rows, or with one label only, the score is that label's smoothed share."""
    y = np.array(ys, dtype=np.float64)
    runs = [run for _, run in B.slices(texts)]
    some = []
    for run in runs:
        h, _, _, _, owner, *_ = tokens(run)
        pair = np.unique(np.stack([owner.astype(np.uint64), h], 1), axis=0)[:, 1] if len(h) else h
        some.append(pair)
    allh = np.concatenate(some) if some else np.zeros(0, dtype=np.uint64)
    u, c = np.unique(allh, return_counts=True)
    best = np.lexsort((u, -c))[:VOCAB]
    vocab = np.sort(u[best[c[best] >= 3]])
    vectors = word_vectors(runs, vocab)
    x = np.concatenate([pool(run, vocab, vectors) for run in runs]) if runs else np.zeros((0, 2 * DIM))
    mean = x.mean(0) if len(x) else np.zeros(2 * DIM)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(2 * DIM)
    if len(set(ys)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        p = [np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.array([np.log(share / (1 - share))])]
        return Model(vocab=vocab, vectors=vectors, mean=mean, scale=scale, w1=p[0], b1=p[1], w2=p[2], b2=p[3], temperature=np.array(1.0)).dump()
    z = (x - mean) / scale
    back = np.arange(len(z)) % 5 == 4
    p = _train(z[~back], y[~back], HIDDEN, 2500, 7)
    logit = (np.maximum(z[back] @ p[0] + p[1], 0) @ p[2] + p[3]).ravel()
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, -np.where(y[back] == 1, 1, -1) * logit / t)) for t in heats] if back.any() else [0.0]
    heat = heats[int(np.argmin(loss))] if back.any() else 1.0
    return Model(vocab=vocab, vectors=vectors, mean=mean, scale=scale, w1=p[0], b1=p[1], w2=p[2], b2=p[3], temperature=np.array(heat)).dump()


def score_documents(docs: DataFrame, model: bytes, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null and empty texts get the score of an empty text.

    Repeated rows each give a row, an empty table none; other columns are not read.
    """
    return score_with(docs, model, Model, threshold, doc_id, text)


_models: dict = {}


def loaded(loader, model: bytes):
    """The model, made once in a worker and kept for its later tasks (the last one only)."""
    if (loader, model) not in _models:
        _models.clear()
        _models[loader, model] = loader.load(model)
    return _models[loader, model]


def score_with(docs, model, loader, threshold, doc_id, text):
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        m = loaded(loader, model)
        for b in B.small(batches):
            s = m.scores([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()).cast(pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold (about ``bound`` of them), score all rows.

    doc_id, held_out, score and predicted of every row, repeated ones too; null
    and empty texts get the score of an empty text, and very long texts are
    scored whole.  An empty table gives no rows; other columns are not read.
    """
    return score_documents(docs, fit_in_task(training_rows(docs, labels, "quality", bound=bound), fit), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``.

    A row is judged by its text alone, a null one as empty and a very long one
    whole; a score equal to the threshold stays.  Repeated rows fare alike, an
    empty table stays empty, and all columns, whatever their names, pass through.
    """
    return filter_with(docs, fit_in_task(training_rows(docs, labels, "quality", bound=bound), fit), Model, lambda s: s >= threshold)


def filter_with(docs, model, loader, rule, text: str = "text"):
    """Rows that the rule keeps, judged by their text alone (null as empty)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        m = loaded(loader, model)
        for b in B.small(batches):
            if b.num_rows:
                s = m.scores([t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()])
                yield b.filter(pa.array(rule(s)))

    return docs.mapInArrow(run, docs.schema)
