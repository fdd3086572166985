"""Byte-level BPE by monoid tree reduction.

A byte string is a token of the table, or its halves are encoded, down to
single bytes, and joined.  Joining re-encodes a window around the seam that
grows until the tokens outside it are provably those of the whole: a sequence of tokens is *the* BPE
encoding of its bytes exactly if every two neighbours are the encoding of their
own bytes, so a window is large enough once its first and last token stand so
with their outer neighbours.  Matches of the split pattern never merge with one
another, so over them the tree's join is concatenation, and decoding
concatenates the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import regex

from trajecta.llm import bytesx as B
from trajecta.ship import ship

#: Bytes of a window that is encoded directly.
WINDOW = 96
#: Parts that a node of the tree over a text's matches concatenates.
FAN = 16
CACHE_CHUNKS, CACHE_PAIRS, CACHE_HALVES = 400_000, 500_000, 200_000
#: Halves of up to so many bytes are kept.
HALF_BYTES = 8
# Fixed value: the split pattern for which a text may be cut at single spaces.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ODD_SPACE = re.compile(r"[^\S \n]")


_made: dict = {}


class TreeCoder:
    """Encoder for one table of ranks; equal to the reference BPE on every byte string."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.spaced = pattern == SPACED
        self.spelling = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.spelling[r] = b
        self.joins = 0
        self._pairs: dict[tuple[int, int], list[int] | None] = {}
        self._halves: dict[bytes, list[int]] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> TreeCoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    @classmethod
    def of(cls, path: str, pattern: str) -> TreeCoder:
        """One for each Python worker, so a task finds what the tasks before it have encoded."""
        if (path, pattern) not in _made:
            _made.clear()
            _made[path, pattern] = cls.load(path, pattern)
        return _made[path, pattern]

    def leaf(self, b: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        ranks = self.ranks
        parts = [b[i : i + 1] for i in range(len(b))]
        got = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
        while True:
            best, at = None, -1
            for i, r in enumerate(got):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del got[at]
            if at < len(got):
                got[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                got[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def seam(self, a: int, b: int) -> list[int] | None:
        """The encoding of two tokens' bytes; None if it is the two tokens themselves."""
        pair = a, b
        try:
            return self._pairs[pair]
        except KeyError:
            if len(self._pairs) > CACHE_PAIRS:
                self._pairs.clear()
        got = self.leaf(self.spelling[a] + self.spelling[b])
        known = self._pairs[pair] = None if got == [a, b] else got
        return known

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        return self.seam(a, b) is None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both texts together from their encodings."""
        self.joins += 1
        if not left or not right or (window := self.seam(left[-1], right[0])) is None:
            return left + right
        i = j = 1
        while True:
            low = i == len(left) or self.seam(left[-i - 1], window[0]) is None
            high = j == len(right) or self.seam(window[-1], right[j]) is None
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if low else min(2 * i, len(left)), j if high else min(2 * j, len(right))
            window = self._window(b"".join([self.spelling[t] for t in left[len(left) - i :] + right[:j]]))

    def _window(self, b: bytes) -> list[int]:
        """What stands around a seam, encoded anew: directly, or by halves itself once it has grown."""
        return self.leaf(b) if len(b) <= WINDOW else self.encode_bytes(b)

    def encode_bytes(self, b: bytes) -> list[int]:
        """One match of the pattern: a token of the table, or its halves joined, down to single bytes."""
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        return self._halved(b) if b else []

    def _halved(self, b: bytes) -> list[int]:
        k = 1 << (len(b) - 1).bit_length() - 1
        return self.join(self._joined(b[:k]), self._joined(b[k:]))

    def _joined(self, b: bytes) -> list[int]:
        """The left half has the largest power of two bytes that is less than the whole, so the depth is the
        logarithm of the length, and equal short halves of different words are encoded and joined once."""
        n = len(b)
        if n == 1:
            return [self.ranks[b]]
        if n > HALF_BYTES:
            return self._halved(b)
        halves = self._halves
        if (ids := halves.get(b)) is None:
            if len(halves) > CACHE_HALVES:
                halves.clear()
            ids = halves[b] = self._halved(b)
        return ids

    def _piece(self, piece: str) -> bytes:
        if (ids := self._pieces.get(piece)) is None:
            ids = array("I", self.encode_bytes(piece.encode("utf-8"))).tobytes()
            if len(piece) <= 64:
                if len(self._pieces) > CACHE_CHUNKS:
                    self._pieces.clear()
                self._pieces[piece] = ids
        return ids

    def _split(self, text: str) -> bytes:
        return up_the_tree([self._piece(p) for p in self.pattern.findall(text)])

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers of this machine (little-endian ones here).

        With the pattern ``SPACED`` a single space between two other characters always starts a match, so a
        text without other runs of space is cut there and the chunks are looked up.
        """
        parts = text.split(" ")
        if not self.spaced or "" in parts or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return self._split(text)
        known, out = self._chunks, []
        mark = ""
        for p in parts:
            ids = known.get(p) if mark else None
            if ids is None:
                ids = self._split(mark + p)
                if mark and len(p) <= 64:
                    if len(known) > CACHE_CHUNKS:
                        known.clear()
                    known[p] = ids
            out.append(ids)
            mark = " "
        return up_the_tree(out)

    def decode_packed(self, ids: bytes) -> bytes:
        """Spellings of the tokens, concatenated up the tree."""
        return up_the_tree(list(map(self.spelling.__getitem__, memoryview(ids).cast("I"))))


def up_the_tree(parts: list[bytes]) -> bytes:
    """Concatenation by levels of a balanced tree: between matches of the pattern, and between decoded tokens, a join is no more."""
    while len(parts) > FAN:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return b"".join(parts)


def digest(coder: TreeCoder, texts: list) -> tuple[list[int], list[str], list[str]]:
    """Numbers of tokens, sha256 of the ids and sha256 of the decoded bytes; null counts as empty."""
    n, ids_sha, dec_sha = [], [], []
    for t in texts:
        ids = coder.encode_packed(t) if t else b""
        n.append(len(ids) // 4)
        ids_sha.append(hashlib.sha256(ids).hexdigest())
        dec_sha.append(hashlib.sha256(coder.decode_packed(ids)).hexdigest())
    return n, ids_sha, dec_sha


def encode_documents(docs, path: str, pattern: str, text: str = "text"):
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 added (columns so named are replaced).

    Nulls and empty texts give zero tokens; very long texts are encoded whole.
    Repeated rows each give a row, and an empty table none.  Any other columns
    pass through.  Between equal ranks the leftmost pair merges first.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    ship(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [f for f in docs.schema.fields if f.name not in names]
    rest = docs.select([docs[f.name] for f in keep])
    out = T.StructType([f for f in keep if f.name != text] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        coder = TreeCoder.of(path, pattern)
        for b in B.small(batches):
            n, i, d = digest(coder, b.column(text).to_pylist())
            kept = [(f.name, b.column(f.name)) for f in keep if f.name != text]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=[k for k, _ in kept] + names)

    return rest.mapInArrow(run, out)
