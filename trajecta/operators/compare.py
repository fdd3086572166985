"""Whether two tables hold the same rows, and where they differ, by sums of row hashes instead of sorting both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key's hash that one step tells apart.
BITS = 12


def comparable(c: Column, kind: T.DataType) -> Column:
    """The same value for values that count as equal: one NaN, no negative zero, maps in the order of their keys, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(float("nan")).cast(kind)).when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        return F.struct(c.isNull(), F.transform(c, lambda x: comparable(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(comparable(e["key"], kind.keyType).alias("k"), comparable(e["value"], kind.valueType).alias("v")))
        return F.struct(c.isNull(), F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))
    if isinstance(kind, T.StructType):
        return F.struct(c.isNull(), *(comparable(c[f.name], f.dataType) for f in kind.fields))
    return c


def row_hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a row; a null and an empty value tell apart, and so do columns."""
    parts = [x for i, n in enumerate(columns) for x in (F.lit(i), df[n].isNull(), comparable(df[n], df.schema[n].dataType), F.size(df[n]) if isinstance(df.schema[n].dataType, (T.ArrayType, T.MapType)) else F.lit(0))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def _sums(df: DataFrame, by: list[Column], hashes: list[str], side: str) -> DataFrame:
    big = [F.sum(F.col(h).cast("decimal(38,0)")).alias(f"{side}_{h}") for h in hashes]
    return df.groupBy(*by).agg(F.count("*").alias(f"{side}_n"), *big)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often, in any order: NaN equals NaN, null equals null, 0 equals -0.

    Columns must have the same names and types, in order.  Each side is read
    once and gives one row, so nothing is sorted or shuffled.  Different tables
    pass for the same with odds of about 2**-128.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        return False
    x, y = (_sums(df.select(*(h.alias(n) for h, n in zip(row_hashes(df, df.columns), ("h1", "h2"), strict=True))), [], ["h1", "h2"], "s").first() for df in (a, b))
    return tuple(x) == tuple(y)


def differing_keys(a: DataFrame, b: DataFrame, key: str, steps: int = 2) -> DataFrame:
    """(key, a_n, b_n): keys whose rows differ, with how many rows each side has.

    Sums for each range of the keys' hashes show which ranges differ; only their
    rows go on, to narrower ranges, and the last ones are compared key by key.
    Equal tables therefore shuffle a few thousand sums.  Null keys are a key.
    """
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError("tables of different columns")
    left, right = (df.select(df[key].alias("k"), F.xxhash64(df[key]).alias("p"), *(h.alias(n) for h, n in zip(row_hashes(df, df.columns), ("h1", "h2"), strict=True))) for df in (a, b))
    differ = ~(F.col("a_n").eqNullSafe(F.col("b_n")) & F.col("a_h1").eqNullSafe(F.col("b_h1")) & F.col("a_h2").eqNullSafe(F.col("b_h2")))
    for step in range(1, steps + 1):
        at = F.shiftrightunsigned("p", 64 - BITS * step).alias("at")
        x, y = _sums(left, [at], ["h1", "h2"], "a"), _sums(right, [at], ["h1", "h2"], "b")
        ranges = x.join(y, "at", "full").where(differ).select("at")
        left, right = (df.join(ranges, at == F.col("at"), "left_semi") for df in (left, right))
    x, y = _sums(left, ["k"], ["h1", "h2"], "a"), _sums(right, [F.col("k").alias("k2")], ["h1", "h2"], "b")
    out = x.join(y, F.col("k").eqNullSafe(F.col("k2")), "full").where(differ)
    return out.select(F.when(F.col("a_n").isNull(), F.col("k2")).otherwise(F.col("k")).alias(key), F.coalesce("a_n", F.lit(0)).alias("a_n"), F.coalesce("b_n", F.lit(0)).alias("b_n"))
