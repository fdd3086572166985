"""Reward functions from files, reward managers by row and by batch, and reductions of resampled values."""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.batch import spread
from trajecta.ship import ship


class LoadedReward:
    """A function of a file's source text, which goes to the workers with it, and the keyword arguments bound to it."""

    def __init__(self, source: str, name: str, kwargs: dict):
        self.source, self.name, self.kwargs = source, name, kwargs

    def __call__(self, *args, **kwargs):
        key = "trajecta_reward_" + hashlib.sha256(self.source.encode()).hexdigest()[:16]
        if key not in sys.modules:
            made = types.ModuleType(key)
            exec(compile(self.source, key, "exec"), made.__dict__)
            sys.modules[key] = made
        return getattr(sys.modules[key], self.name)(*args, **kwargs, **self.kwargs)


def load_reward(path: str | None, name: str | None, **kwargs) -> LoadedReward | None:
    """The named function of a Python file; None without a path.  A missing file, a broken one or a missing name raise."""
    if not path:
        return None
    if not os.path.exists(path):
        raise FileNotFoundError(f"no reward file at {path}")
    with open(path, encoding="utf-8") as f:
        source = f.read()
    scope: dict = {"__name__": "trajecta_reward"}
    try:
        exec(compile(source, path, "exec"), scope)
    except Exception as e:
        raise RuntimeError(f"the reward file {path} can't be run: {e}") from e
    if not callable(scope.get(name or "")):
        raise AttributeError(f"no function {name} in {path}")
    return LoadedReward(source, str(name), kwargs)


def manage(df: DataFrame, reward: Callable, source: str, response: str, truth: str, extra: str | None = None, by: str = "row", failed: float | None = None) -> DataFrame:
    """``df`` with score and score_info (JSON of what else the function returned).

    by="row": ``reward(source, response, truth, extra)`` for each row gives a
    number or a dict with "score".  by="batch": the same with lists of a bounded
    batch.  With ``failed`` a row (or batch) whose call raises gets that score;
    else the task fails and Spark runs it again.
    """
    if by not in ("row", "batch"):
        raise ValueError(f"no manager by {by}")
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("score_info", T.StringType())])

    def split(got):
        if isinstance(got, dict):
            return float(got["score"]), json.dumps({k: v for k, v in got.items() if k != "score"}, sort_keys=True, default=str)
        return float(got), "{}"

    def call(args):
        try:
            return reward(*args)
        except Exception:
            if failed is None:
                raise
            return [failed] * len(args[0]) if by == "batch" else failed

    def run(parts):
        for pdf in parts:
            cols = [pdf[c].tolist() for c in (source, response, truth)] + [pdf[extra].tolist() if extra else [None] * len(pdf)]
            got = call(cols) if by == "batch" else [call(x) for x in zip(*cols, strict=True)]
            pairs = [split(g) for g in got]
            yield pdf.assign(score=[p[0] for p in pairs], score_info=[p[1] for p in pairs])

    return df.mapInPandas(run, schema)


def reduce_udf(reduce: Callable, returns: str = "double"):
    """A Python reduction of a group's values (a pandas Series) for ``groupBy().agg``; Spark gathers the group for it, so groups must be small."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(values):
        return reduce(values)

    run.__annotations__ = {"values": pd.Series, "return": float}
    return pandas_udf(run, returns)


def best(x: np.ndarray, ok: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Greatest value of each column; NaN is the greatest of all."""
    return (x.max(0), None) if ok is None else (np.where(ok, x, -np.inf).max(0), ok.any(0))


def worst(x: np.ndarray, ok: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    return (np.fmin.reduce(x, 0), None) if ok is None else (np.fmin.reduce(np.where(ok, x, np.nan), 0), ok.any(0))


#: Reductions of resamples, one in each column: values and which of them are not null (None: all) to a value for each column, and which of those are not null.
REDUCE: dict[str, Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray | None]]] = {"best": best, "worst": worst}
#: Numbers drawn at once for one uid.
MOST_DRAWN = 1 << 18
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of ints that are not negative, on top of the hash of the columns before."""
    h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.uint64) * _P1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def majority(at: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """For each column of drawn places the first one whose vote (a number) is drawn most often; ties go to the vote that comes first."""
    k, draws = at.shape
    key = votes[at] * draws + np.arange(draws)
    often = np.bincount(key.ravel())[key]
    # the count, then how early it comes
    last = (often * k + np.arange(k - 1, -1, -1)[:, None]).max(0)
    return at[k - 1 - last % k, np.arange(draws)]


def resampled(values: np.ndarray, ok: np.ndarray | None, votes: np.ndarray | None, null_vote: int, seed: int, draws: int, reduce: dict) -> dict[tuple[str, int], tuple[float | None, float | None]]:
    """Mean and population std over the draws of each reduction and size of resample; ``seed`` is the hash that the draws go on from."""
    n = len(values)
    sizes = [2**i for i in range(1, 31) if 2**i < n] + [n]
    got: dict[tuple[str, int], list] = {}
    step = max(1, MOST_DRAWN // n)
    for low in range(0, draws, step):
        own = _hashed(np.arange(low, min(draws, low + step)), np.array([seed], dtype=np.int64).view(np.uint64))
        at = _hashed(np.arange(1, n + 1)[:, None], own[None, :]).view(np.int64) % n
        x, good = values[at], None if ok is None else ok[at]
        for k in sizes:
            for name, f in reduce.items():
                got.setdefault((name, k), []).append(f(x[:k], None if good is None else good[:k]))
            if votes is not None:
                first = majority(at[:k], votes)
                real = None if ok is None and null_vote < 0 else (votes[first] != null_vote) & (True if ok is None else ok[first])
                got.setdefault(("maj", k), []).append((values[first], real))
    out = {}
    for key, parts in got.items():
        x = np.concatenate([v if real is None else v[real] for v, real in parts])
        out[key] = (float(x.mean()), float(x.std())) if len(x) else (None, None)
    return out


def majority_value(votes: Column, values: Column) -> Column:
    """The value beside the first of the most frequent votes; ties go to the vote that comes first."""
    kinds = F.array_distinct(votes)
    counts = F.transform(kinds, lambda k: F.size(F.filter(votes, lambda v: v.eqNullSafe(k))))
    vote = F.element_at(kinds, F.array_position(counts, F.array_max(counts)).cast("int"))
    return F.element_at(values, F.array_position(votes, vote).cast("int"))


def validation_table(df: DataFrame, source: str, uid: str, value: str, order: str, vote: str | None = None, draws: int = 1000, seed: int = 42, reduce: dict[str, Callable] | None = None) -> DataFrame:
    """(source, metric, value, n_uid): mean@N and std@N of each uid's N responses and, over resamples of 2, 4, 8 .. and N of them with replacement, mean and std of the best, the worst and the majority's value, averaged over the uids of a source.

    Resamples are drawn by hash; those of one draw begin alike, so they are
    drawn once and cut to each size.  A uid's responses are one array: as many
    as rollouts were asked for, a few dozen.  ``reduce`` is like ``REDUCE``.
    """
    reduce = REDUCE if reduce is None else reduce
    ship(df.sparkSession)
    vote_col = F.col(vote).cast("string") if vote else F.lit("")
    g = df.groupBy(source, uid).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"), vote_col.alias("p")))).alias("x"))
    g = g.select(source, uid, F.size("x").alias("n"), F.transform("x", lambda x: x["v"]).alias("v"), F.transform("x", lambda x: x["p"]).alias("p"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    std = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / F.col("n"))
    name = lambda k, n: F.concat(F.lit(f"{k}@"), n.cast("string"))
    plain = g.withColumn("_m", mean).select(source, F.explode(F.array(F.struct(name("mean", F.col("n")).alias("metric"), F.col("_m").alias("value")), F.struct(F.when(F.col("n") > 1, name("std", F.col("n"))).alias("metric"), std.alias("value")))).alias("z")).select(source, "z.*").where("metric is not null")

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                v, p = b["v"][i].values, b["p"][i].values
                codes, null = None, -1
                if vote:
                    codes = p.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                    null = int(codes[p.is_null().to_numpy(zero_copy_only=False).argmax()]) if p.null_count else -1
                ok = v.is_valid().to_numpy(zero_copy_only=False) if v.null_count else None
                got = resampled(v.fill_null(0.0).to_numpy(zero_copy_only=False), ok, codes, null, b["h"][i].as_py(), draws, reduce)
                rows += [(i, f"{m}@{k}/{s}", x) for (m, k), both in got.items() for s, x in zip(("mean", "std"), both, strict=True)]
            at, metric, x = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b[source].take(pa.array(at, pa.int64())), pa.array(metric, pa.string()), pa.array(x, pa.float64())], [source, "metric", "value"])

    x = spread(g.where("n > 1"), source, uid).select(source, "v", "p", F.xxhash64(F.lit(seed), uid).alias("h"))
    drawn = x.mapInArrow(run, T.StructType([df.schema[source], T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())]))
    return plain.unionByName(drawn).groupBy(source, "metric").agg(F.avg("value").alias("value"), F.count("*").alias("n_uid"))
