"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored in context windows.

The lexicon is learned: terms that labelled toxic documents hold and clean ones
don't, each with a log-odds weight.  A word of a text runs through the trie of
the lexicon intersected with the Levenshtein automata of its terms: one edit is
allowed in a term of four letters, two in one of eight.  The intersection is
made deterministic as words need it, so most words leave it after a few
letters.  Words seen in clean training documents are never taken for
misspellings.

A hit's window is the eight words on either side.  Quotation marks around the
hit or a word of reporting in the window make it a mention, which counts for a
quarter; other hits in the window make it abuse and count once more.  Exact
hits, misspellings and mentions are summed apart and a logistic regression
turns the sums into a probability.  Few misspellings stand in the sample, so
every toxic training text is also fitted on with its terms misspelled.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from trajecta.llm.labelled import SAMPLE_ROWS, fit_in_task, training_rows
from trajecta.llm.random_indexing import filter_with, score_with

TERMS, MIN_DOCS, MIN_SHARE, MIN_ODDS = 1024, 5, 0.008, 2.0
WINDOW, MENTION, MIN_FUZZY, LONG = 8, 0.25, 4, 8
#: States of the automaton that a worker keeps.
STATES = 100_000
#: Words whose outcome a worker keeps.
SEEN = 40_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»„‚‹›…–—¡¿"
OPEN, CLOSE = set("\"'“‘«„‚‹»›"), set("\"'”’»“«›‹")
#: Words of reporting.
REPORTING = frozenset("said says say quote quoted quotes quoting word words term phrase called calls wrote writes sagte sagt zitat wort dit mot citation dijo dice palabra cita".split())


def allowed(term: str) -> int:
    """Edits within which a word is taken for the term."""
    return (len(term) >= MIN_FUZZY) + (len(term) >= LONG)


class Trie:
    """Lexicon as nested nodes; ``walk`` intersects it with the bit-parallel automaton of one word."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def near(self, word: str) -> bool:
        """Whether a term is within one edit."""
        return bool(self.walk(word))

    def walk(self, word: str, edits: int = 1) -> list[tuple[str, int]]:
        """Terms within so many edits of the word, with their distance.

        Bit i of vector e is set while the first i letters of the word have been
        matched by the path with e edits; a node whose vectors are all empty is cut.
        """
        n = len(word)
        bits: dict[str, int] = {}
        for i, c in enumerate(word):
            bits[c] = bits.get(c, 0) | 1 << i
        accept = 1 << n
        start = [(1 << (e + 1)) - 1 & (2 * accept - 1) for e in range(edits + 1)]
        found, todo = [], [(self.root, start)]
        while todo:
            node, r = todo.pop()
            for c, child in node.items():
                if c == "":
                    e = next((e for e, x in enumerate(r) if x & accept), None)
                    if e is not None:
                        found.append((child, e))
                    continue
                b = bits.get(c, 0)
                s = [(r[0] & b) << 1]
                for e in range(1, edits + 1):
                    s.append(((r[e] & b) << 1 | r[e - 1] | r[e - 1] << 1 | s[e - 1] << 1) & (2 * accept - 1))
                if any(s):
                    todo.append((child, s))
        return found


class Automaton:
    """The trie of the lexicon intersected with the Levenshtein automata of its terms, deterministic, built as words need it.

    A state is a set of trie nodes, each with the least number of edits that
    leads to it and not more than some term below it allows.
    """

    def __init__(self, terms):
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]
        for t in terms:
            node, k = 0, allowed(t)
            self.room[0] = max(self.room[0], k)
            for c in t:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                    self.room.append(0)
                node = self.kids[node][c]
                self.room[node] = max(self.room[node], k)
            self.term[node] = t
        self.letters = {c for k in self.kids for c in k}
        self._clear()

    def _clear(self) -> None:
        self.sets: list[dict[int, int]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[tuple[str, int], ...]] = []
        self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        """Number of the state of these nodes and those that letters left out lead to; -1 for none."""
        todo = list(best)
        while todo:
            node = todo.pop()
            e = best[node] + 1
            for child in self.kids[node].values():
                if e <= self.room[child] and e < best.get(child, 9):
                    best[child] = e
                    todo.append(child)
        if not best:
            return -1
        key = tuple(sorted(best.items()))
        if (n := self.numbers.get(key)) is None:
            n = self.numbers[key] = len(self.sets)
            self.sets.append(best)
            self.steps.append({})
            self.found.append(tuple((t, e) for node, e in key if (t := self.term[node]) is not None and e <= allowed(t)))
        return n

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, e in self.sets[state].items():
            if e < self.room[node] and e + 1 < best.get(node, 9):  # a letter too many
                best[node] = e + 1
            for letter, child in self.kids[node].items():
                cost = e if letter == c else e + 1
                if cost <= self.room[child] and cost < best.get(child, 9):
                    best[child] = cost
        return self._state(best)

    def hits(self, word: str) -> tuple[tuple[str, int], ...]:
        """Terms within the edits that they allow, with their distance."""
        if len(self.sets) > STATES:
            self._clear()
        state, steps, letters = 0, self.steps, self.letters
        for c in word:
            if c not in letters:
                c = ""
            nxt = steps[state].get(c)
            if nxt is None:
                nxt = steps[state][c] = self._step(state, c)
            if nxt < 0:
                return ()
            state = nxt
        return self.found[state]


def misspelt(term: str, salt: int) -> str:
    """The term with as many edits as it allows, at places and with letters chosen by hash."""
    h = int.from_bytes(hashlib.blake2b(f"{term} {salt}".encode(), digest_size=8).digest(), "little")
    out = list(term)
    for _ in range(1 + h % max(1, allowed(term))):
        h, at = divmod(h >> 3, len(out))
        h, letter = divmod(h, 26)
        kind = h % 3
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out[at] = chr(97 + letter)
        else:
            out.insert(at, chr(97 + letter))
    return "".join(out)


def strip(word: str) -> str:
    return word.strip(EDGE)


class Model:
    FEATURES = 6

    def __init__(self, terms: dict[str, float], clean: set[str], coef: list[float]):
        self.terms, self.clean, self.coef = terms, clean, coef
        self.near = Automaton(terms)
        crowd = Counter(t for w in clean for t, _ in self.near.hits(w))
        #: A term with many clean words around it is seldom what a new word near it means.
        self.trust = {t: 1 / (1 + crowd[t]) for t in terms}
        self.seen: dict[str, tuple[float, int] | None] = {}

    def dump(self) -> bytes:
        return json.dumps({"terms": self.terms, "clean": sorted(self.clean), "coef": self.coef}).encode()

    @classmethod
    def load(cls, b: bytes) -> Model:
        x = json.loads(b)
        return cls(x["terms"], set(x["clean"]), x["coef"])

    def look(self, chunk: str) -> tuple[float, int] | None:
        """Weight and edits of the best term that a word is taken for."""
        w = strip(chunk)
        if w in self.terms:
            return self.terms[w], 0
        if len(w) < MIN_FUZZY or w in self.clean:
            return None
        return max(((self.terms[t] * self.trust[t], e) for t, e in self.near.hits(w)), default=None)

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(self.FEATURES)
        x[0] = 1
        words = text.lower().split()
        seen = self.seen
        if len(seen) > SEEN:
            seen.clear()
        kinds = set(words)
        hot = {}
        for c in kinds:
            try:
                got = seen[c]
            except KeyError:
                got = self.look(c)
                if len(c) <= 64:
                    seen[c] = got
            if got:
                hot[c] = got
        if not hot:
            return x
        at = [i for i, w in enumerate(words) if w in hot]
        terms = set()
        for k, i in enumerate(at):
            weight, edits = hot[words[i]]
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = words[i][0] in OPEN and words[i][-1] in CLOSE and len(words[i]) > 1
            quoted = quoted or self._inside(words, i)
            said = any(strip(w) in REPORTING for w in around)
            others = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(at) and abs(at[j] - i) <= WINDOW)
            if quoted or said:
                x[4] += weight
                weight *= MENTION
            if edits == 0:
                x[1] += weight
                terms.add(strip(words[i]))
            else:
                x[2] += weight
            x[3] += weight * others / 2
        x[5] = len(terms)
        x[1:5] = np.log1p(np.maximum(x[1:5], 0))
        x[5] = np.log1p(x[5])
        return x

    @staticmethod
    def _inside(words: list[str], i: int) -> bool:
        """An opening mark before the hit and a closing one after it, within the window."""
        before = next((j for j in range(i, max(-1, i - WINDOW - 1), -1) if words[j][0] in OPEN), None)
        if before is None or any(words[j][-1] in CLOSE and len(words[j]) > 1 for j in range(before, i)):
            return False
        return any(words[j].rstrip(".,;:!?")[-1:] in CLOSE for j in range(i, min(len(words), i + WINDOW + 1)))

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = np.array([self.features(t) for t in texts]) @ np.array(self.coef)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lexicon(texts: list[str], ys: list[int]) -> tuple[dict[str, float], set[str]]:
    """Terms with weights, and the words near a term that clean documents hold."""
    by = {0: Counter(), 1: Counter()}
    places: dict[str, set[tuple[str, str]]] = {}
    for t, y in zip(texts, ys, strict=True):
        words = [strip(w) for w in t.lower().split()]
        by[1 if y else 0].update(set(words))
        if y:
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                places.setdefault(w, set()).add((before, after))
    for w in by[1]:  # copies of one text count once: they have the same words on either side
        by[1][w] = min(by[1][w], len(places[w]))
    n1, n0 = sum(1 for y in ys if y), sum(1 for y in ys if not y)
    least = max(MIN_DOCS, MIN_SHARE * n1)
    odds = {}
    for w, c in by[1].items():
        if c >= least and len(w) > 1:
            o = np.log((c + 0.5) / (n1 + 1)) - np.log((by[0][w] + 0.5) / (n0 + 1))
            if o >= MIN_ODDS and c >= 4 * by[0][w]:
                odds[w] = float(o)
    terms = dict(sorted(odds.items(), key=lambda x: (-x[1] * by[1][x[0]], x[0]))[:TERMS])
    near = Automaton(terms)
    return terms, {w for w in by[0] if len(w) >= MIN_FUZZY and w not in terms and near.hits(w)}


def _logistic(x: np.ndarray, y: np.ndarray, base: list[float]) -> np.ndarray:
    """Weights of a logistic regression with a weak prior, by Newton's method."""
    w = np.array(base)
    prior = np.array([1e-6, *[0.02] * (len(base) - 1)]) * len(y) / 50
    w[1:4] = 0.6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - y) + prior * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list, ys: list) -> bytes:
    """Model from texts and 0/1 labels; without both labels the score is the smoothed share of label 1."""
    texts = [t or "" for t in texts]
    y = np.array(ys, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = [float(np.log(share / (1 - share)))] + [0.0] * (Model.FEATURES - 1)
    if len(set(ys)) < 2:
        return Model({}, set(), base).dump()
    terms, clean = lexicon(texts, ys)
    m = Model(terms, clean, base)
    # a text's own clean words must not shield it here, so each half is read with the clean words of the other
    x, marks = [], []
    for half in (0, 1):
        there = {strip(c) for k, t in enumerate(texts) if k % 2 != half and not ys[k] for c in t.lower().split()}
        other = Model(terms, clean & there, base)
        other.trust = m.trust
        for k, t in enumerate(texts):
            if k % 2 == half:
                x.append(other.features(t))
                marks.append(float(y[k]))
                if y[k]:
                    x.append(other.features(" ".join([misspelt(strip(c), k) if allowed(strip(c)) and strip(c) in terms else c for c in t.lower().split()])))
                    marks.append(1.0)
    x, y = np.array(x), np.array(marks)
    w = _logistic(x, y, base)
    w[2] = min(w[2], w[1])  # a misspelling is no more evidence than the term itself
    m.coef = [float(v) for v in w]
    return m.dump()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Fitted on labelled rows outside the held-out fold (about ``bound``).  Null
    and empty texts get the score of a text without hits; very long texts are
    scored whole.  Of terms equally near to a word the heaviest counts.
    Repeated rows each give a row, an empty table none; other columns are not
    read.
    """
    model = fit_in_task(training_rows(docs, labels, "toxic", bound=bound), fit)
    return score_with(docs, model, Model, threshold, "doc_id", "text")


def keep_clean(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, threshold: float = 0.5, bound: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` scored below the threshold; ``labelled_docs`` (``docs`` if none) hold the training texts.

    A row is judged by its text alone, a null one as empty and a very long one
    whole; a score equal to the threshold goes.  Repeated rows fare alike, an
    empty table stays empty, and all columns, whatever their names, pass through.
    """
    model = fit_in_task(training_rows(labelled_docs if labelled_docs is not None else docs, labels, "toxic", bound=bound), fit)
    return filter_with(docs, model, Model, lambda s: s < threshold)
