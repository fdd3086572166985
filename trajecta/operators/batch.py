"""Batches: ordinals, repeats, chunks, padding, balancing and packing by token budget."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Dense positions from 0 by the given order, without a window over all rows.

    Rows are dealt by range and numbered inside their partition; the counts of
    the partitions (one number each) give the offsets.
    """
    from trajecta.sources.tables import cut

    spread = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    base = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_low"))
    base = base.select("_p", "_low", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    return spread.join(F.broadcast(base), "_p").withColumn(name, F.col("_i") - F.col("_low") + F.coalesce("_before", F.lit(0))).drop("_p", "_i", "_low", "_before")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows over all cores by hash, for work that is long though the bytes are few: splits of files and joined partitions go by bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def repeat(df: DataFrame, n: Column | int, interleave: bool = True) -> DataFrame:
    """Each row n times (none for 0), with its copy number; order is by row or by copy when sorted by ``copy``."""
    count = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("copy", F.explode(F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>")))).withColumn("block_first", F.lit(not interleave))


def chunks(df: DataFrame, ordinal: str, size: int, exact: bool = False) -> DataFrame:
    """Chunk of each row by its ordinal; ``exact`` raises where rows don't divide."""
    out = df.withColumn("chunk", F.floor(F.col(ordinal) / size))
    if exact:
        bad = df.agg((F.count("*") % size).alias("_rest"))
        out = out.join(F.broadcast(bad)).withColumn("chunk", F.when(F.col("_rest") != 0, F.raise_error(F.lit("rows do not divide into chunks")).cast("long")).otherwise(F.col("chunk"))).drop("_rest")
    return out


def pad_to(df: DataFrame, ordinal: str, divisor: int) -> DataFrame:
    """Rows from the start again until their number divides, marked by ``is_pad``; small tables go round more than once."""
    n = df.agg(F.count("*").alias("_n"))
    need = n.select("_n", F.pmod(-F.col("_n"), F.lit(divisor)).alias("_pad"))
    extra = need.where("_pad > 0 and _n > 0").select("_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pad") - 1)).alias("_k"))
    more = extra.withColumn("_at", F.col("_k") % F.col("_n")).join(df, F.col("_at") == F.col(ordinal)).withColumn(ordinal, F.col("_n") + F.col("_k"))
    return df.withColumn("is_pad", F.lit(False)).unionByName(more.select(*df.columns).withColumn("is_pad", F.lit(True)))


def zipped(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Rows of the same position side by side; tables of different length raise."""
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), ordinal, "full_outer")
    return j.where(F.when(F.col("_a") & F.col("_b"), True).otherwise(F.raise_error(F.lit("tables differ in length")).cast("boolean"))).drop("_a", "_b")


def select_slice(df: DataFrame, ordinal: str, start: int, stop: int, step: int = 1) -> DataFrame:
    o = F.col(ordinal)
    return df.where((o >= start) & (o < stop) & ((o - start) % step == 0))


def shard(df: DataFrame, ordinal: str, n: int, i: int) -> DataFrame:
    return df.where(F.pmod(F.col(ordinal), F.lit(n)) == i)


def fold(df: DataFrame, ordinal: str, k: int, value: str) -> DataFrame:
    """k neighbouring rows as one array; ``unfold`` is posexplode."""
    return df.groupBy(F.floor(F.col(ordinal) / k).alias("row")).agg(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, value))), lambda x: x[value]).alias("values"))


def workload(length: Column) -> Column:
    """Cost of a sequence of this length: linear layers and attention."""
    return 24576 * length + length * length


def greedy(costs: list[int], k: int) -> list[int]:
    """Part of each item in the given order: the one of least load so far, lower number first."""
    heap = [(0, p) for p in range(k)]
    out = []
    for c in costs:
        load, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (load + c, p))
    return out


def largest_differencing(costs: list[int], k: int, equal: bool) -> list[int]:
    """Karmarkar-Karp: parts of near-equal sums; ``equal`` also makes their sizes equal (items must divide by k)."""
    n = len(costs)
    if not n:
        return []
    if equal and n % k:
        raise ValueError("items do not divide into parts of equal size")
    order = sorted(range(n), key=lambda i: (costs[i], i))

    def state(parts):
        parts = sorted(parts, key=lambda x: (-x[0], x[1]))
        return (parts[0][0] - parts[-1][0], parts)

    heap, count = [], 0
    groups = [order[i : i + k] for i in range(0, n, k)] if equal else [[i] for i in order]
    for g in groups:
        parts = [(costs[i], [i]) for i in g] + [(0, [])] * (k - len(g))
        spread, p = state(parts)
        heapq.heappush(heap, (-spread, count, p))
        count += 1
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        spread, p = state([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)])
        heapq.heappush(heap, (-spread, count, p))
        count += 1
    out = [0] * n
    for p, (_, items) in enumerate(heap[0][2]):
        for i in items:
            out[i] = p
    return out


def balance(df: DataFrame, batch: str, order: str, length: str, k: int, equal: bool = False, method: str = "kk") -> DataFrame:
    """``part`` of each row inside its batch.  A batch is bounded by its size in training, so it is one group of applyInPandas."""
    schema = df.select(batch, order, length).schema.add("part", T.IntegerType())

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        n = pdf[length].astype("int64")
        costs = (24576 * n + n * n).tolist()
        pdf["part"] = np.array(largest_differencing(costs, k, equal) if method == "kk" else greedy(costs, k), dtype="int32")
        return pdf

    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, schema)


def micro_batches(df: DataFrame, batch: str, order: str, length: str, budget: int) -> DataFrame:
    """``micro`` of each row: as few parts of the batch as its tokens need, balanced by workload."""
    schema = df.select(batch, order, length).schema.add("micro", T.IntegerType())

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        n = pdf[length].astype("int64")
        k = max(1, min(len(pdf), int(-(-n.sum() // budget))))
        pdf["micro"] = np.array(largest_differencing((24576 * n + n * n).tolist(), k, False), dtype="int32")
        return pdf

    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, schema)


def sequential_pack(df: DataFrame, batch: str, order: str, length: str, rows: int, tokens: int) -> DataFrame:
    """``pack`` of each row, filled in order: a new one begins where the row or token cap would break (padding to the longest counts)."""
    schema = df.select(batch, order, length).schema.add("pack", T.IntegerType())

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        out, pack, n, longest = [], 0, 0, 0
        for x in pdf[length]:
            top = max(longest, x)
            if n and (n + 1 > rows or top * (n + 1) > tokens):
                pack, n, top = pack + 1, 0, x
            n, longest = n + 1, top
            out.append(pack)
        pdf["pack"] = np.array(out, dtype="int32")
        return pdf

    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, schema)


def imbalance(df: DataFrame, batch: str, length: str, part: str) -> DataFrame:
    """Least, greatest and mean token sums of the parts of each batch."""
    s = df.groupBy(batch, part).agg(F.sum(length).alias("s"))
    return s.groupBy(batch).agg(F.min("s").alias("part_min"), F.max("s").alias("part_max"), F.avg("s").alias("part_mean"))


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same in every run: those of least MD5 (TakeOrdered, no full sort)."""
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]).cast("binary"))
    return df.orderBy(h, *key).limit(n)


def weighted_draws(df: DataFrame, key: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement by weight: evenly hashed points against running sums of the weights in order of key.

    Rows and points meet by an equi-join on cells of the sums' range, as many as
    there are draws; a row stands in the cells that it reaches over, in all as
    many as rows and draws together.
    """
    from trajecta.operators.layout import running_weights
    from trajecta.operators.shop import unit_hash

    run = running_weights(df.select(key, F.col(weight).cast("double").alias("_x")).where("_x > 0"), key, "_x")
    total = run.agg(F.max("high").alias("_t"))
    cell = lambda c: F.least(F.floor(c / F.col("_t") * draws), F.lit(draws - 1))
    points = df.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(total)).withColumn("_u", unit_hash(F.lit(seed), F.col("draw")) * F.col("_t"))  # one row
    points = points.select("draw", "_u", cell(F.col("_u")).alias("_c"))
    rows = run.join(F.broadcast(total)).select(key, "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("_c"))
    return points.join(rows, "_c").where("_u >= low and _u < high").select("draw", key)
