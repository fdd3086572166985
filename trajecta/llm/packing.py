"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's cost is ``linear * n + quadratic * n * n`` (attention grows with
the square).  Batches of bounded size are packed one by one inside their task:
documents in descending order go to the sequence of lowest cost that still has
room; a document that fits nowhere whole is cut over the sequences with room.
A batch of T tokens gets floor(T / capacity) full sequences, and the rest is
laid into sequences of falling powers of two, which need no padding.  Nothing
is shuffled, and a retried task repeats the same result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np

from trajecta.llm import bytesx as B
from trajecta.ship import ship

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / 24576
#: Tokens of one batch; larger batches pad and balance no better.
BATCH_TOKENS = 1 << 20
CACHE_WORDS = 400_000
END_ID = 1
#: Fast path only for these characters; in all other texts the library splits words itself.
_PLAIN = re.compile(r"[ \n\t\r!-~\xa1-\xac\xae-ŷŹ-ǿ]*")
_SUB = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# The settings of a tokenizer file that the two patterns above follow.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD_NUMBER = re.compile(r"[\xb2\xb3\xb9\xbc-\xbe]")


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


BYTE_CHARS = _byte_chars()


class WordCoder:
    """Ids of a ``tokenizers`` file whose words are parted by white space, looked up by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.fast = self._follows(json.loads(self.lib.to_str()))
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _follows(file: dict) -> bool:
        """Whether words may be looked up one by one; files with other settings go through the library whole."""
        split = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        normal = (file.get("normalizer") or {}).get("normalizers")
        return normal == _NORMALIZERS and split[0].get("pattern") == {"Regex": _SPLIT} and [x.get("type") for x in split] == ["Split", "ByteLevel"] and file.get("truncation") is file.get("padding") is None

    def _plain(self, text: str) -> bool:
        if not self.fast:
            return False
        m = _PLAIN.fullmatch(text)
        return bool(m) and not _ODD_NUMBER.search(text) and unicodedata.is_normalized("NFC", text)

    def _learn(self, words: list[str]) -> None:
        """Words that are new: their pieces are looked up, and pieces that are new go to the model itself."""
        known, pieces, model = self.known, self.pieces, self.lib.model.tokenize
        if len(pieces) > CACHE_WORDS:
            pieces.clear()
        for w in words:
            out = []
            for p in _SUB.findall(w):
                if (ids := pieces.get(p)) is None:
                    spelt = p if p.isascii() else "".join([BYTE_CHARS[b] for b in p.encode("utf-8")])
                    ids = pieces[p] = array("I", [t.id for t in model(spelt)]).tobytes()
                out.append(ids)
            known[w] = b"".join(out)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        split: list = []
        fresh: dict[str, None] = {}
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for i, t in enumerate(texts):
            if self._plain(t):
                ws = t.lower().split()
                split.append((i, ws))
                fresh.update(dict.fromkeys([w for w in ws if w not in known]))
            else:
                out[i] = array("I", self.lib.encode(t, add_special_tokens=False).ids).tobytes()
        self._learn(list(fresh))
        for i, ws in split:
            out[i] = b"".join([known[w] for w in ws])
        return out


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def room_for(total: int, capacity: int = CAPACITY) -> list[int]:
    """Sizes of the sequences of a batch: full ones, then falling powers of two."""
    sizes = [capacity] * (total // capacity)
    rest, bit = total % capacity, capacity
    while bit:
        if rest & bit:
            sizes.append(bit)
        bit >>= 1
    return sizes


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one batch.

    Whole sequences are cut off long documents first.  What is left goes, the
    longest first, to the sequence of lowest cost that has room for it whole; if
    none has, it is cut over the roomiest ones.  Ties go to the lower document
    and the lower sequence.
    """
    sizes = room_for(sum(lengths), capacity)
    pieces = []
    rest: list[tuple[int, int, int]] = []
    full = 0
    whole = sum(1 for s in sizes if s == capacity)
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= capacity and full < whole:
            pieces.append((d, start, capacity, full, 0))
            full, start = full + 1, start + capacity
        if n > start:
            rest.append((n - start, d, start))
    left = np.array(sizes, dtype=np.int64)
    left[:full] = 0
    spent = np.zeros(len(sizes))
    dear = np.full(len(sizes), np.inf)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, s, sizes[s] - int(left[s])))
        left[s] -= n
        spent[s] += cost(n)

    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        s = int(np.where(left >= n, spent, dear).argmin())
        if left[s] >= n:
            put(d, start, n, s)
            continue
        while n:
            s = int(left.argmax())
            take = min(n, int(left[s]))
            put(d, start, take, s)
            start, n = start + take, n - take
    return pieces


def pack_documents(docs, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY):
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and then is the end id alone.  A null doc_id and
    repeated rows are packed like others, and very long texts are cut over as
    many sequences as they fill.  Documents of equal length go in the order of
    their rows, to the lower of sequences of equal cost.  sequence_id is the partition's
    number times 2**32 plus a count, so no task waits for another.  An empty
    table gives no rows; other columns are not read.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    ship(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))

    def run(batches):
        from pyspark import TaskContext

        coder, made = WordCoder(path), TaskContext.get().partitionId() << 32
        end = array("I", [END_ID]).tobytes()
        ids, held, size = [], [], 0

        def flush():
            nonlocal made, size
            lengths = [len(x) // 4 for x in held]
            got = pack(lengths, capacity)
            crc = [zlib.crc32(memoryview(held[d])[4 * a : 4 * (a + n)]) for d, a, n, _, _ in got]
            cols = list(zip(*got, strict=True))
            who = pa.array(ids).take(pa.array(cols[0], pa.int64()))
            out = pa.RecordBatch.from_arrays([who, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(crc, pa.int64()), pa.array([lengths[d] for d in cols[0]], pa.int64()), pa.array([made + s for s in cols[3]], pa.int64()), pa.array(cols[4], pa.int64())], names=schema.names)
            made += max(cols[3]) + 1
            ids.clear()
            held.clear()
            size = 0
            return out

        for b in B.small(batches):
            who, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                for i, x in zip(who[k : k + 256], coder.encode_packed([t or "" for t in texts[k : k + 256]]), strict=True):
                    ids.append(i)
                    held.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= BATCH_TOKENS:
                        yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, schema)
