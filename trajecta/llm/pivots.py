"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest reference points (pivots) in
order.  Inverted lists, one for each label and pair of pivots, hold the vectors
that have both in their description, so vectors of a list share two pivots at
least; such a pair of vectors is taken in the list of its two smallest shared
pivots alone and verified by its cosine in double precision.  A list that is
still hot is dealt into blocks and worked off by pairs of blocks, so it isn't
gathered in one task; a pair of blocks gives counts and a spanning forest,
never the pairs.

Pivots come from a sample of bounded size, chosen so that no two are close;
their number grows with the square root of the number of vectors, up to
``PIVOT_BYTES``.  The tests hold recall against brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.tables import components, cut, discard
from trajecta.ship import ship

PREFIX, SHARED, MIN_PIVOTS, APART = 5, 2, 16, 0.8
#: Bytes of the pivots, which every task holds, and of the sample that they are chosen from.
PIVOT_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20
BLOCK = 1024


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n unit rows of the sample, in its order, none with a cosine of over APART to another."""
    out = np.empty((min(n, len(sample)), sample.shape[1] if sample.ndim == 2 else 0))
    m = 0
    for v in sample:
        if m == len(out):
            break
        if not m or (out[:m] @ v).max() <= APART:
            out[m] = v
            m += 1
    return out[:m]


def nearest(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Indices of the nearest pivots, nearest first (ties: lower index)."""
    k = min(PREFIX, len(pivots))
    close = -(unit @ pivots.T)
    if len(pivots) > 8 * PREFIX:
        some = np.sort(np.argpartition(close, 4 * k, axis=1)[:, : 4 * k], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(close, some, 1), axis=1, kind="stable")[:, :k], 1)
    return np.argsort(close, axis=1, kind="stable")[:, :k]


def pairs_of(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of pivots of each description, the lower first; a description of one pivot is a pair with itself."""
    k = near.shape[1]
    i, j = np.triu_indices(k, 1) if k > 1 else (np.zeros(1, dtype=int), np.zeros(1, dtype=int))
    return np.minimum(near[:, i], near[:, j]), np.maximum(near[:, i], near[:, j])


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked_pairs(p: int, q: int, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, least: float, same: bool) -> np.ndarray:
    """Matrix of links between unit rows a and b that belong to the list of pivots p and q: no other shared pivot is below q."""
    ok = a @ b.T >= least
    rows, cols = np.nonzero(ok)
    if len(rows):
        x, y = da[rows], db[cols]
        lower = (x[:, :, None] == y[:, None, :]) & (x[:, :, None] < q) & (x[:, :, None] != p)
        ok[rows, cols] = ~lower.any((1, 2))
    return np.triu(ok, 1) if same else ok


def _forest(ok: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that tie what the matrix links, as few as that takes."""
    rows, cols = ok.shape
    row_left, col_left, out = np.ones(rows, dtype=bool), np.ones(cols, dtype=bool), []
    for start in range(rows):
        if not row_left[start]:
            continue
        row_left[start] = False
        todo = [start]
        while todo:
            r = todo.pop()
            new = np.flatnonzero(ok[r] & col_left)
            col_left[new] = False
            for c in new:
                out.append((r, int(c)))
                more = np.flatnonzero(ok[:, c] & row_left)
                row_left[more] = False
                for q in more:
                    out.append((int(q), int(c)))
                    todo.append(int(q))
    return out


def _describe(rows: DataFrame) -> DataFrame:
    """vec_id, label, ok, key and vec (doubles) from (vec_id, label, embedding)."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            label, emb = b.column(1).to_pylist(), b.column(2).to_pylist()
            vec, key = [], []
            for y, e in zip(label, emb, strict=True):
                v = None
                if y is not None and e and None not in e:
                    x = np.array(e, dtype="<f8")
                    with np.errstate(over="ignore"):
                        n = float(np.sqrt((x * x).sum()))
                    if not np.isfinite(n) and np.isfinite(x).all():
                        x = x / np.abs(x).max()
                        n = float(np.linalg.norm(x))
                    if np.isfinite(n) and n == 0 and x.any():
                        x = x / np.abs(x).max()
                        n = 1.0
                    if np.isfinite(n) and n > 0:
                        v = x.tobytes()
                vec.append(v)
                key.append(None if v is None else hashlib.blake2b(v, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "key", "vec"])

    return rows.mapInArrow(run, T.StructType([rows.schema["vec_id"], rows.schema["label"], *T._parse_datatype_string("key binary, vec binary").fields]))


def _lists(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(label, dim, p, q, node, copies, near, vec): a row for each pair of pivots of each vector's description."""
    import pyarrow as pa

    schema = T.StructType([classes.schema["label"], *T._parse_datatype_string("dim int, p int, q int, node long, copies long, near binary, vec binary").fields])

    def run(batches):
        for b in batches:
            vec = b.column(3).to_pylist()
            dims = np.array([len(v) // 8 for v in vec])
            for d in np.unique(dims) if len(vec) else []:
                at = np.flatnonzero(dims == d)
                x = unit_rows(np.frombuffer(b"".join([vec[i] for i in at]), dtype="<f8").reshape(len(at), d))
                near = nearest(x, pivots[int(d)]).astype("<i4")
                low, high = pairs_of(near)
                k = low.shape[1]
                pick = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pick), pa.array(np.full(len(pick), d), pa.int32()), pa.array(low.ravel(), pa.int32()), pa.array(high.ravel(), pa.int32()), b.column(1).take(pick), b.column(2).take(pick), pa.array([n.tobytes() for n in near for _ in range(k)], pa.binary()), b.column(3).take(pick)], names=schema.names
                )

    return classes.select("label", "node", "copies", "vec").mapInArrow(run, schema)


def _links(pairs: DataFrame, least: float) -> DataFrame:
    """(node, links, other): counts of linked vectors, and edges of forests."""
    import pyarrow as pa

    def work(p, q, dim, held):
        side = np.array([h[0] for h in held])
        order = np.argsort(side, kind="stable")
        held, side = [held[k] for k in order], side[order]
        node = np.array([h[1] for h in held], dtype=np.int64)
        copies = np.array([h[2] for h in held], dtype=np.int64)
        near = np.frombuffer(b"".join([h[3] for h in held]), dtype="<i4").reshape(len(held), -1).astype(np.int64)
        x = unit_rows(np.frombuffer(b"".join([h[4] for h in held]), dtype="<f8").reshape(len(held), dim))
        out = []
        same = not side.any()
        cut_at = len(held) if same else int((side == 0).sum())
        if not cut_at:
            return out
        # a list's block may be larger than meant (hashing): rows go in steps, so the matrices stay small
        for lo in range(0, cut_at, BLOCK):
            hi = min(lo + BLOCK, cut_at)
            for lo2 in range(lo if same else cut_at, len(held), BLOCK):
                hi2 = min(lo2 + BLOCK, len(held))
                ok = linked_pairs(p, q, x[lo:hi], x[lo2:hi2], near[lo:hi], near[lo2:hi2], least, same and lo == lo2)
                if not ok.any():
                    continue
                a, b = ok @ copies[lo2:hi2], copies[lo:hi] @ ok
                out += [(int(node[lo + i]), int(a[i]), None) for i in np.flatnonzero(a)]
                out += [(int(node[lo2 + i]), int(b[i]), None) for i in np.flatnonzero(b)]
                out += [(int(node[lo + i]), 0, int(node[lo2 + j])) for i, j in _forest(ok)]
        return out

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "links", "other"])

    def run(batches):
        held, key = [], None
        for b in batches:
            got = []
            for label, dim, p, q, i, j, *rest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (label, dim, p, q, i, j) != key:
                    got += work(key[2], key[3], key[1], held) if len(held) > 1 else []
                    held, key = [], (label, dim, p, q, i, j)
                held.append(rest)
            if got:
                yield batch(got)
        if len(held) > 1 and (got := work(key[2], key[3], key[1], held)):
            yield batch(got)

    return pairs.select("label", "dim", "p", "q", "i", "j", "side", "node", "copies", "near", "vec").mapInArrow(run, "node long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows with a null label, a null, empty or zero vector or one with null or
    non-finite components link with nothing, as do vectors of different length.
    Equal vectors of one label are linked with one another without being paired.
    component_id is the least vec_id that isn't null; kept is false for a null
    vec_id.  Repeated rows count as other vectors; an empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(_describe(vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[embedding].alias("embedding"))))
    one = rows.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    classes = cut(one.select(F.monotonically_increasing_id().alias("node"), "*"))
    per = {int(r["d"] // 8): int(r["n"]) for r in classes.groupBy(F.octet_length("vec").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    pivots = {}
    for d, n in per.items():
        k = int(min(max(MIN_PIVOTS, PIVOT_BYTES // (8 * d)), max(MIN_PIVOTS, 2 * n**0.5)))
        some = [r["vec"] for r in classes.where(F.octet_length("vec") == 8 * d).orderBy(F.xxhash64("key"), "label").limit(min(max(MIN_PIVOTS, SAMPLE_BYTES // (8 * d)), 4 * k)).select("vec").collect()]
        pivots[d] = choose_pivots(unit_rows(np.frombuffer(b"".join(some), dtype="<f8").reshape(-1, d)), k)
    lists = cut(_lists(classes, pivots))
    key = ["label", "dim", "p", "q"]
    size = lists.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    dealt = lists.join(size, key).withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select(*key, F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), F.when(F.col("k") > F.col("m"), 1).otherwise(0).alias("side"), "node", "copies", "near", "vec")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(parts, *key, "i", "j").sortWithinPartitions(*key, "i", "j")
    found = cut(_links(pairs, least))
    comp = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = cut(found.groupBy("node").agg(F.sum("links").alias("links")))
    discard(lists, found)
    named = classes.select("node", "label", "key", "copies", "least").join(comp, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = named.join(low, "root").select("label", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    slim = rows.drop("vec")
    found = slim.where("key is not null").join(answer, ["label", "key"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return found.union(slim.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))
