"""Layouts of batches: reorders, permutations, padded and ragged arrays, mini-batches and dispatch over ranks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.batch import largest_differencing, with_ordinal


def dealt_positions(costs: list[int], ranks: int, mini: int | None = None) -> list[int]:
    """New place of each item: ranks of equal size and near-equal cost one after the other, inside a rank the cheap ones at both ends.

    With ``mini`` every so many items are dealt on their own, and items after
    the last whole mini-batch raise.
    """
    step = mini or len(costs)
    if step and len(costs) % step:
        raise ValueError("items do not divide into mini-batches")
    members: list[list[int]] = [[] for _ in range(ranks)]
    for at in range(0, len(costs), step or 1):
        part = largest_differencing(costs[at : at + step], ranks, True)
        for i, p in enumerate(part):
            members[p].append(at + i)
    place = [0] * len(costs)
    to = 0
    for own in members:
        own.sort(key=lambda i: (costs[i], i))
        for i in own[::2] + own[1::2][::-1]:
            place[i] = to
            to += 1
    return place


def reorder(df: DataFrame, batch: str, order: str, length: str, ranks: int, mini: int | None = None) -> DataFrame:
    """``position`` and ``rank`` of each row of a batch after balancing.  A batch is one training step, so it is one group."""
    schema = df.select(batch, order, length).schema.add("position", T.IntegerType()).add("rank", T.IntegerType())

    def run(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        n = pdf[length].astype("int64")
        place = dealt_positions((24576 * n + n * n).tolist(), ranks, mini)
        pdf["position"] = np.array(place, dtype="int32")
        pdf["rank"] = (pdf["position"] // max(1, len(pdf) // ranks)).astype("int32")
        return pdf

    return df.select(batch, order, length).groupBy(batch).applyInPandas(run, schema)


def inverse(df: DataFrame, at: str, to: str) -> DataFrame:
    """The inverse of a permutation given as rows (at, to); a place that is hit twice raises."""
    twice = df.groupBy(to).agg(F.count("*").alias("_n"))
    ok = df.join(twice, to).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("not a permutation")).cast("boolean")))
    return ok.select(F.col(to).alias(at), F.col(at).alias(to))


def unfold(df: DataFrame, row: str, values: str, k: int, ordinal: str = "ordinal", value: str = "value") -> DataFrame:
    """Arrays of k neighbours back to rows."""
    return df.select(F.col(row), F.posexplode(values).alias("_i", value)).select((F.col(row) * k + F.col("_i")).alias(ordinal), value)


def ragged(values: Column, mask: Column) -> Column:
    """The values at places whose mask is not 0."""
    both = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    return F.transform(both, lambda x: x["v"])


def padded(df: DataFrame, values: str, fill: Column, left: bool = False, multiple: int = 1) -> DataFrame:
    """Arrays of all rows filled up to the longest (rounded up to a multiple), and ``mask`` of the places that were there."""
    n = df.agg(F.coalesce(F.max(F.size(values)), F.lit(0)).alias("_m")).select((F.ceil(F.col("_m") / multiple) * multiple).cast("int").alias("_m"))
    v = F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType))
    more = F.greatest(F.col("_m") - F.size(v), F.lit(0))
    ones, zeros, extra = F.array_repeat(F.lit(1), F.size(v)), F.array_repeat(F.lit(0), more), F.array_repeat(fill, more)
    out, mask = (F.concat(extra, v), F.concat(zeros, ones)) if left else (F.concat(v, extra), F.concat(ones, zeros))
    return df.join(F.broadcast(n)).withColumns({"mask": mask, values: out}).drop("_m")  # one row


def mini_batches(df: DataFrame, key: str, size: int, epochs: int = 1, seed: int = 0, drop_last: bool = False) -> DataFrame:
    """(epoch, batch, place) of each row: in every epoch all rows in an order of their own, by hash."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.col(key).cast("string")).cast("binary")))
    x = with_ordinal(e, ["epoch", "_h", key], "_at").drop("_h")
    n = df.agg(F.count("*").alias("_n"))
    x = x.join(F.broadcast(n)).withColumn("_at", F.col("_at") - F.col("epoch") * F.col("_n"))  # one row
    x = x.withColumns({"batch": F.floor(F.col("_at") / size), "place": F.col("_at") % size})
    return (x.where(F.col("batch") < F.floor(F.col("_n") / size)) if drop_last else x).drop("_at", "_n")


def longest_first(df: DataFrame, length: Column, tie: list[str], n: int | None = None) -> DataFrame:
    """Rows by falling length (ties by the given columns): all, or the first n without a full sort."""
    out = df.orderBy(length.desc(), *tie)
    return out if n is None else out.limit(n)


def running_weights(df: DataFrame, key: str, weight: str, block: int = 4096) -> DataFrame:
    """``low`` and ``high``: sums of the weights before and up to each row in order of key; sums run inside blocks and are offset by the blocks' totals."""
    from pyspark.sql import Window

    x = with_ordinal(df, [key], "_pos").withColumns({"_b": F.floor(F.col("_pos") / block), "_w": F.col(weight).cast("double")})
    totals = x.groupBy("_b").agg(F.sum("_w").alias("_t"))
    before = totals.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy("_b").orderBy("_pos"))
    return x.join(before, "_b").withColumn("high", F.col("_before") + inside).withColumn("low", F.col("high") - F.col("_w")).drop("_pos", "_b", "_w", "_before")


MODES: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {}


def mode(name: str):
    """Decorator: a way to send rows to ranks; it adds the column ``rank``."""

    def put(f):
        MODES[name] = f
        return f

    return put


@mode("one_to_all")
def one_to_all(df: DataFrame, ordinal: str, ranks: int) -> DataFrame:
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


@mode("rank_zero")
def rank_zero(df: DataFrame, ordinal: str, ranks: int) -> DataFrame:
    return df.withColumn("rank", F.lit(0))


@mode("dp_compute")
def dp_compute(df: DataFrame, ordinal: str, ranks: int) -> DataFrame:
    """Neighbouring rows to the same rank, as many to each; rows that don't divide raise."""
    n = df.agg(F.count("*").alias("_n"))
    each = F.when(F.col("_n") % ranks != 0, F.raise_error(F.lit("rows do not divide over the ranks")).cast("long")).otherwise(F.greatest(F.col("_n") / ranks, F.lit(1)).cast("long"))
    return df.join(F.broadcast(n)).withColumn("rank", F.floor(F.col(ordinal) / each).cast("int")).drop("_n")  # one row


def dispatch(df: DataFrame, name: str, ordinal: str, ranks: int, work, schema, parts: int | None = None) -> DataFrame:
    """Rows sent to ranks, worked off there (``work``: iterator of pandas frames to the same) and put together again.

    A rank's rows are worked off in their order, in stretches of neighbours by
    several tasks where they are many (``parts`` over all ranks), so ``work``
    sees a stretch of a rank, or several ranks after one another.
    """
    if name not in MODES:
        raise ValueError(f"no mode named {name}")
    return MODES[name](df, ordinal, ranks).repartitionByRange(parts or ranks, "rank", ordinal).sortWithinPartitions("rank", ordinal).mapInPandas(work, schema)
