"""Best-fit packing by a hierarchy of residuals.

Every task packs its own documents best-fit, the longest first, and hands on
the sequences that are nearly full.  The rest, underfull sequences, are items of
the next level: groups of ``FAN`` tasks fit them into one another, hand on what
is nearly full now, reopen the rest and fit their pieces once more where that
saves sequences, and so on up a tree.  A node passes up at most ``CARRY``
underfull sequences, those with the most room; it hands on all others as they
are, so no task holds more than ``FAN * CARRY`` of them however large the input
is, and no document is left out.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm import bytesx as B
from trajecta.llm.packing import BYTE_CHARS
from trajecta.llm.tables import cut
from trajecta.ship import ship

CAPACITY = 2048
END_ID = 0
#: A sequence with no more room than this is nearly full.
SLACK = 8
#: Items that a task packs at once, sequences that a node passes up, and nodes that meet in one of the next level.
ITEMS, CARRY, FAN = 1 << 17, 2048, 16
#: Chunks and pieces kept in memory, and their longest.
CACHE_CHUNKS, CHUNK_CHARS = 500_000, 40
#: A run of white space belongs to the word behind it; words never look beyond the white space before them.
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Texts with other white space go through the library whole.
_OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


# Fixed value: how a byte-level file splits text; for these characters all Unicode tables agree.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACE = BYTE_CHARS[32]
_SIMPLE = re.compile("[\n\t\r -~\xa1-\u024f]*")


class ByteCoder:
    """Ids of a byte-level BPE file of ``tokenizers``, looked up by word with the white space before it.

    A word seen for the first time is split, its pieces are looked up, and new
    ones go to the model itself.
    """

    _made: dict[str, ByteCoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        file = json.loads(self.lib.to_str())
        split = file.get("pre_tokenizer") or {}
        #: Files with other settings go through the library whole.
        self.fast = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and file.get("normalizer") is file.get("truncation") is file.get("padding") is None
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ByteCoder:
        """One for each Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, chunks: set[str], simple: bool) -> None:
        known, pieces, model = self.known, self.pieces, self.lib.model.tokenize
        if len(pieces) > CACHE_CHUNKS:
            pieces.clear()
        for c in chunks:
            if len(c) > CHUNK_CHARS or not (simple or _SIMPLE.fullmatch(c)):
                known[c] = self._whole(c)
                continue
            out = []
            for p in _SPLIT.findall(c):
                if (ids := pieces.get(p)) is None:
                    spelt = p.replace(" ", SPACE) if p.isprintable() and p.isascii() else "".join([BYTE_CHARS[b] for b in p.encode("utf-8")])
                    ids = pieces[p] = array("I", [t.id for t in model(spelt)]).tobytes()
                out.append(ids)
            known[c] = b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.fast or _OTHER_SPACE.search(text):
            return self._whole(text)
        chunks, known = _CHUNK.findall(text), self.known
        if new := set(chunks).difference(known):
            if len(known) > CACHE_CHUNKS:
                known.clear()
                new = set(chunks)
            self._learn(new, _SIMPLE.fullmatch(text) is not None)
        out = b"".join(map(known.__getitem__, chunks))
        for c in new:
            if len(c) > CHUNK_CHARS:
                del known[c]
        return out


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item: the largest first, each into the fullest bin that has room for it.

    Items of equal size go in their order, and of equally full bins the one
    that was filled last is taken.  Bins are stacked by their room, and the bits
    of one number tell which stacks hold any.
    """
    which, place = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, made = 0, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        if above := bits >> n:
            room = n + (above & -above).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                bits &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        which[k], place[k] = b, capacity - room
        if room > n:
            stacks[room - n].append(b)
            bits |= 1 << (room - n)
    return which, place


class Bins:
    """Pieces in underfull sequences: columns of numbers, ids beside them, and the fill of every sequence."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.ids, self.fill = capacity, [], np.zeros(0, dtype=np.int64)
        #: piece, start, length, ids_crc32, sequence, offset
        self.rows = np.zeros((0, 6), dtype=np.int64)

    def add(self, ids: list, rows: np.ndarray, fill: np.ndarray) -> None:
        """Pieces whose column of sequences counts from 0 over ``fill``."""
        rows = rows.copy()
        rows[:, 4] += len(self.fill)
        self.ids, self.rows, self.fill = self.ids + ids, np.concatenate([self.rows, rows]), np.concatenate([self.fill, fill])

    def fit(self) -> None:
        """Sequences as items: fitted into one another, and their pieces moved along."""
        which, place = best_fit(self.fill, self.capacity)
        at = self.rows[:, 4]
        self.rows[:, 5] += place[at]
        self.rows[:, 4] = which[at]
        self.fill = np.bincount(which, weights=self.fill).astype(np.int64) if len(which) else self.fill

    def reopen(self) -> None:
        """A further round: the pieces of the sequences as items, kept if fewer sequences hold them."""
        which, place = best_fit(self.rows[:, 2], self.capacity)
        if len(which) and int(which.max()) + 1 < len(self.fill):
            self.rows[:, 4], self.rows[:, 5] = which, place
            self.fill = np.bincount(which, weights=self.rows[:, 2]).astype(np.int64)

    def take(self, chosen: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Remove the chosen sequences: their ids, rows and fills, counted from 0."""
        number = np.where(chosen, np.cumsum(chosen), np.cumsum(~chosen)) - 1
        out = chosen[self.rows[:, 4]]
        self.rows[:, 4] = number[self.rows[:, 4]]
        got = [i for i, x in zip(self.ids, out.tolist(), strict=True) if x], self.rows[out], self.fill[chosen]
        self.ids = [i for i, x in zip(self.ids, out.tolist(), strict=True) if not x]
        self.rows, self.fill = self.rows[~out], self.fill[~chosen]
        return got

    def full(self, carry: int) -> np.ndarray:
        """The nearly full ones, and the fullest of those beyond ``carry``."""
        chosen = self.fill >= self.capacity - SLACK
        left = np.flatnonzero(~chosen)
        if len(left) > carry:
            chosen[left[np.argsort(-self.fill[left], kind="stable")[: len(left) - carry]]] = True
        return chosen


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length): whole if it fits, else full pieces behind a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


_NUMBERS = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _batch(schema, ids: list, rows: np.ndarray, fill: np.ndarray, node: int, first: int, done: bool):
    import pyarrow as pa

    numbers = [rows[:, 0].astype(np.int32), rows[:, 1], rows[:, 2], rows[:, 3], first + rows[:, 4], rows[:, 5]]
    cols = [pa.array(ids, schema.field(0).type), *map(pa.array, numbers), pa.array(fill[rows[:, 4]]), pa.array(np.full(len(ids), node)), pa.array(np.full(len(ids), done))]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


def leaves(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int) -> DataFrame:
    """Level 0: pieces with their sequence in this task, its fill, and whether it is handed on (``done``)."""
    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = _schema(docs.schema[doc_id].dataType)
    arrow = _arrow(schema)

    def run(batches):
        from pyspark import TaskContext

        node, made = TaskContext.get().partitionId(), 0
        coder, end = ByteCoder.of(path), array("I", [END_ID]).tobytes()
        bins = Bins(capacity)
        ids, new = [], []

        def flush(last: bool):
            nonlocal made, ids, new
            table = np.array(new, dtype=np.int64).reshape(-1, 6)
            table[:, 4] = np.arange(len(table))
            bins.add(ids, table, table[:, 2].copy())
            ids, new = [], []
            bins.fit()
            for carry in (len(bins.fill), CARRY):
                got = bins.take(bins.full(carry))
                if len(got[0]):
                    yield _batch(arrow, *got, node, (node << 32) + made, True)
                    made += len(got[2])
                if carry != CARRY:
                    bins.reopen()
            if last and len(bins.ids):
                yield _batch(arrow, bins.ids, bins.rows, bins.fill, node, (node << 32) + made, False)

        for b in B.small(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = coder.encode(t or "") + end
                for k, (a, n) in enumerate(pieces_of(len(x) // 4, capacity)):
                    ids.append(i)
                    new.append((k, a, n, zlib.crc32(memoryview(x)[4 * a : 4 * (a + n)]), 0, 0))
            if len(new) >= ITEMS:
                yield from flush(False)
        yield from flush(True)

    return rows.mapInArrow(run, schema)


def _schema(kind: T.DataType) -> T.StructType:
    more = [T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in (*_NUMBERS, "fill", "node")]
    return T.StructType([T.StructField("doc_id", kind), *more, T.StructField("done", T.BooleanType())])


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def merged(rest: DataFrame, level: int, fan: int, capacity: int, root: bool) -> DataFrame:
    """One level up: the underfull sequences of ``fan`` nodes as items of one node."""
    arrow = _arrow(rest.schema)

    def run(table):
        import pyarrow as pa

        node = table.column("node")[0].as_py() // fan
        old, at = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
        rows = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _NUMBERS], axis=1)
        fill = np.zeros(len(old), dtype=np.int64)
        fill[at] = table.column("fill").to_numpy()
        rows[:, 4] = at
        bins = Bins(capacity)
        bins.add(table.column("doc_id").to_pylist(), rows, fill)
        bins.fit()
        first, out = (level << 56) + (node << 32), []
        for carry in (len(bins.fill), 0 if root else CARRY):
            got = bins.take(bins.full(carry))
            out.append(_batch(arrow, *got, node, first, True))
            first += len(got[2])
            if len(out) == 1:
                bins.reopen()
        return pa.Table.from_batches([*out, _batch(arrow, bins.ids, bins.rows, bins.fill, node, first, False)], arrow)

    return rest.groupBy(F.floor(F.col("node") / fan)).applyInArrow(run, rest.schema)


def pack_best_fit(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, fan: int = FAN) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizer file and the end id.  Null text
    counts as empty and then is the end id alone.  A null doc_id and repeated
    rows are packed like others.  Only documents longer than ``capacity`` are
    cut: all their pieces but the first are full sequences.  Documents of equal
    length go in the order of their rows.  An empty table gives no rows; other
    columns are not read.
    """
    level0 = cut(leaves(docs, path, doc_id, text, capacity))
    out, rest = [level0.where("done")], level0.where("not done")
    nodes = rest.agg(F.max("node")).collect()[0][0]
    level = 0
    while nodes is not None:
        nodes, level = nodes // fan, level + 1
        up = cut(merged(rest, level, fan, capacity, nodes == 0))
        out.append(up.where("done"))
        rest = up.where("not done")
        if not nodes:
            break
    found = out[0]
    for x in out[1:]:
        found = found.union(x)
    return found.select("doc_id", *_NUMBERS)
