"""Document fingerprints by a homomorphic multiset hash.

A fingerprint is the sum of one wide vector for each paragraph (line):

* 8 lanes of 64 bits, the BLAKE2b digest of the paragraph, added modulo 2**64.
  Equal multisets of paragraphs have equal lanes in whatever order.
* 256 lanes of 16 bits, added modulo 2**16: the paragraph's three-word shingles
  (byte four-grams in paragraphs of under eight words), each adding a hashed
  sign to a hashed lane.

Adding a paragraph's vector inserts it and subtracting it deletes it, so an
edit costs only the paragraphs that it touches.  The small lanes, read as
signed numbers, keep inner products: likeness is 2ab / (aa + bb), cut to 0..1,
and 1 where all lanes agree.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np

from trajecta.llm import bytesx as B
from trajecta.ship import ship

WIDE, SMALL, SHORT_WORDS, SHINGLE, GRAM = 8, 256, 8, 3, 4


def paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all paragraphs and the paragraph that each is of."""
    h, bounds, count = B.shingles(run, SHINGLE, lower=False)
    owner = np.repeat(np.arange(len(run)), np.diff(bounds))
    short = count < SHORT_WORDS
    keep = ~short[owner]
    h, owner = h[keep], owner[keep]
    if short.any():
        buf, starts, ends = B.lay(run, b" ")
        which = np.flatnonzero(short & (ends > starts))
        made = np.maximum(ends[which] - starts[which] - GRAM + 1, 1)
        at = np.repeat(starts[which], made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
        stop = np.minimum(at + GRAM, np.repeat(ends[which], made))
        h = np.concatenate([h, B.span_hash(B.prefix_hash(buf), at, stop)])
        owner = np.concatenate([owner, np.repeat(which, made)])
    return h, owner


def vectors(groups: list[list[bytes]]) -> np.ndarray:
    """The sum of the paragraphs' vectors for each group, as bytes in rows (lanes are little-endian)."""
    sizes = np.fromiter(map(len, groups), dtype=np.int64, count=len(groups))
    flat = [p for g in groups for p in g]
    out = np.zeros((len(groups), 8 * WIDE + 2 * SMALL), dtype=np.uint8)
    if not flat:
        return out
    group = np.repeat(np.arange(len(groups)), sizes)
    digest = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in flat]), dtype="<u8").reshape(-1, WIDE)
    full = np.flatnonzero(sizes)
    wide = np.zeros((len(groups), WIDE), dtype="<u8")
    wide[full] = np.add.reduceat(digest, (np.cumsum(sizes) - sizes)[full], axis=0)
    h, owner = _features(flat)
    cell = group[owner] * SMALL + (h & B.U(SMALL - 1)).astype(np.int64)
    sign = ((h >> B.U(40)) & B.U(1)).astype(np.float64) * 2 - 1
    small = np.bincount(cell, weights=sign, minlength=len(groups) * SMALL).astype(np.int64).astype("<u2").reshape(-1, SMALL)
    out[:, : 8 * WIDE] = wide.view(np.uint8)
    out[:, 8 * WIDE :] = small.view(np.uint8)
    return out


def combine(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    """a + b or a - b, lane by lane."""
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    out = np.empty_like(a)
    cut = 8 * WIDE
    x, y = np.ascontiguousarray(a[:, :cut]).view("<u8"), np.ascontiguousarray(b[:, :cut]).view("<u8")
    out[:, :cut] = (x + y if sign > 0 else x - y).view(np.uint8)
    x, y = np.ascontiguousarray(a[:, cut:]).view("<u2"), np.ascontiguousarray(b[:, cut:]).view("<u2")
    out[:, cut:] = (x + y if sign > 0 else x - y).view(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a[:, 8 * WIDE :]).view("<i2").astype(np.float64)
    y = np.ascontiguousarray(b[:, 8 * WIDE :]).view("<i2").astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    near = np.clip(2 * (x * y).sum(1) / np.where(both == 0, 1, both), 0, 1)
    return np.where((a == b).all(1), 1.0, near)


def show(v: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in v]


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text (null: empty)."""
    return show(vectors([paragraphs(text or "")]))[0]


def edited(text: str, nxt: str) -> str:
    """The last quarter of the code points gives way to the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + nxt[:k]


def edit_paragraphs(text: str, nxt: str) -> tuple[list[bytes], list[bytes]]:
    """Paragraphs that the edit takes away and those that it puts in."""
    k = len(text) // 4
    if not k:
        return [], []
    cut = text.rfind("\n", 0, len(text) - k) + 1
    return paragraphs(text[cut:]) or [b""], (text[cut : len(text) - k] + nxt[:k]).encode("utf-8", "surrogatepass").split(b"\n")


def _place(rows, kind):
    """A double that never falls as doc_id rises: the number itself, or for texts the six bytes after what all ids begin with."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = F.col("doc_id").cast("binary")
        ends = rows.agg(F.hex(F.min(raw)).alias("a"), F.hex(F.max(raw)).alias("b")).collect()[0]
        a, b = ends["a"] or "", ends["b"] or ""
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) // 2
        return F.conv(F.rpad(F.substring(F.hex(raw), 2 * same + 1, 12), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col("doc_id").cast("timestamp").cast("double")
    return F.col("doc_id").cast("double")


def _order(docs, doc_id: str, text: str, parts: int):
    """Rows by (pid, sub, guest, doc_id, h): ranges of doc_id, each ending with a copy of the first row of the next range.

    A range that holds one doc_id only, such as that of nulls, is split by the
    hash of the text where it has more rows than two even shares.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import functions as F

    kind = docs.schema[doc_id].dataType
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    place = _place(rows.select("doc_id"), kind)
    cuts = sorted(set(rows.select(place.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    rows = rows.withColumns({"x": F.coalesce(place, F.lit(0.0)), "h": F.sha2("text", 256)})
    rows = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="x", outputCol="b").transform(rows)
    rows = rows.select("doc_id", "text", "h", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("b").cast("int")).alias("pid"), F.lit(0).alias("guest"))
    sizes = rows.groupBy("pid").agg(F.count("*").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).collect()  # at most parts + 1 rows
    even = sum(r["n"] for r in sizes) / parts
    hot = {r["pid"]: int(r["n"] / even) + 1 for r in sizes if r["one"] and r["n"] > 2 * even}
    sub = F.lit(0)
    for pid, k in hot.items():  # fewer than half as many as parts
        sub = F.when(F.col("pid") == pid, F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * k).cast("int")).otherwise(sub)
    rows = rows.withColumn("sub", sub)
    firsts = [(r["pid"], r["sub"], r["m"]["doc_id"], r["m"]["h"]) for r in rows.groupBy("pid", "sub").agg(F.min(F.struct("doc_id", "h")).alias("m")).orderBy("pid", "sub").collect()]  # at most twice parts
    if not firsts:
        return rows
    small = rows.sparkSession.createDataFrame([(*firsts[i - 1][:2], d, h) for i, (*_, d, h) in enumerate(firsts)], f"to_pid int, to_sub int, g_id {kind.simpleString()}, g_h string")
    guests = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")))
    guests = guests.select("doc_id", "text", "h", F.col("to_pid").alias("pid"), F.lit(1).alias("guest"), F.col("to_sub").alias("sub")).dropDuplicates(["pid", "sub"])
    return rows.union(guests).repartition(parts, "pid", "sub").sortWithinPartitions("pid", "sub", "guest", "doc_id", "h")


def fingerprint_documents(docs, doc_id: str = "doc_id", text: str = "text", parts: int | None = None):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the next row by (doc_id, sha256 of the text), nulls
    first, and after the last the first; a single row follows itself.  doc_id
    may be a number, a text or a time.  Null text counts as empty: its
    fingerprint is all zero, and two such are alike (1).  Very long texts are
    taken whole.  Repeated rows each give a row and follow one another; an empty
    table gives none; other columns are not read.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = docs.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _order(docs, doc_id, text, parts)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def some(batches, limit=B.SLICE_BYTES):
        """Rows in runs of bounded size; the last of a run comes again as the first of the next."""
        run, size = [], 0
        for b in B.small(batches):
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True):
                run.append(row)
                size += len(row[1])
                if size >= limit and len(run) > 1:
                    yield run
                    run, size = [row], len(row[1])
        if len(run) > 1:
            yield run

    def calc(batches):
        for run in some(batches):
            texts = [t for _, t, _ in run]
            own = [i for i in range(len(run) - 1) if not run[i][2]]
            if not own:
                continue
            edits = [edit_paragraphs(texts[i], texts[i + 1]) for i in own]
            v = vectors([paragraphs(t) for t in texts] + [x for x, _ in edits] + [x for _, x in edits])
            n, m = len(texts), len(own)
            base, nxt = v[:n][own], v[:n][[i + 1 for i in own]]
            new = combine(combine(base, v[n : n + m], -1), v[n + m :], 1)
            ed = [hashlib.sha256(edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass")).hexdigest() for i in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([run[i][0] for i in own], type=to_arrow), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array(ed), pa.array(show(base)), pa.array(show(new)), pa.array(likeness(base, new)), pa.array(likeness(base, nxt))], names=schema.names
            )

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(docs.schema[doc_id].dataType)
    return rows.select("doc_id", "text", "h", "pid", "guest").mapInArrow(calc, schema)
