"""Written tables that cut lineage, and connected components over them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm import bytesx as B
from trajecta.sources.tables import cut, discard, shared_dir  # noqa: F401


def packed(docs: DataFrame, text: str, hashed: bool = True) -> DataFrame:
    """``docs`` with its text compressed (``__tj_z``) and its sha256 (``__tj_sha``): a third of the bytes where texts are shuffled."""
    import pyarrow as pa

    rest = [f for f in docs.schema.fields if f.name != text]
    more = [*(["__tj_sha"] if hashed else []), "__tj_z"]

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in B.small(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column(len(rest)).to_pylist()]
            sha = [pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())] if hashed else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *sha, pa.array([z.compress(x) for x in raw], pa.binary())], names=[*(f.name for f in rest), *more])

    return docs.select(*(docs[f.name] for f in rest), docs[text]).mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.BinaryType()) for c in more)]))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; nodes share a root exactly if they are connected.

    Each round points every node to the least of itself and its neighbours (in
    a hashed order, so that chains break up evenly), follows the pointers twice
    and contracts the edges along them.  Edges shrink by a constant factor, so
    all rounds together move a small multiple of the edges.  Only minima are
    gathered for a node, so a hub costs its map tasks and not one reducer.
    Null ends and loops are left out; no edges give no rows.
    """
    first = lambda x: F.struct(F.xxhash64(x).alias("p"), F.col(x).alias("n"))
    e = cut(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    steps, spent = [], [e]
    for _ in range(rounds):
        both = e.union(e.select("b", "a").toDF("a", "b"))
        up = both.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("node"), F.least(first("a"), "m")["n"].alias("up"))
        up = cut(up)
        spent.append(up)
        jump = up.select(F.col("node").alias("at"), F.col("up").alias("to"))
        up = cut(up.join(jump, up.up == jump.at).select("node", F.col("to").alias("up")))
        steps.append(up)
        spent.append(up)
        ends = up.select(F.col("node").alias("x"), F.col("up").alias("a2"))
        other = up.select(F.col("node").alias("y"), F.col("up").alias("b2"))
        e = cut(e.join(ends, e.a == ends.x).join(other, F.col("b") == other.y).where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        spent.append(e)
        if e.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = steps[0].select("node", F.col("up").alias("root"))
    for up in steps[1:]:
        nxt = up.select(F.col("node").alias("at"), F.col("up").alias("to"))
        label = label.join(nxt, label.root == nxt.at, "left").select("node", F.coalesce("to", "root").alias("root"))
    label = cut(label)
    discard(*spent)
    return label
