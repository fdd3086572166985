"""Group-relative advantages: one score for each response, grouped by prompt.

Every estimator takes a DataFrame with a group column, a score column and, for
ties, an order column, and adds ``advantage`` (and what it was made of).  All
are windows or aggregates over the group, so Spark partitions by group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}
EPS = 1e-6


def register(name: str):
    def put(f):
        ESTIMATORS[name] = f
        return f

    return put


def get(name: str) -> Callable[..., DataFrame]:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator {name}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name]


def _w(group: str):
    return Window.partitionBy(group)


@register("grpo")
def grpo(df: DataFrame, group: str, score: str, by_std: bool = True, **_) -> DataFrame:
    """(s - mean) / (std + eps) with the sample std; a single response has mean 0 and std 1."""
    n = F.count(score).over(_w(group))
    mean = F.when(n > 1, F.avg(score).over(_w(group))).otherwise(0.0)
    std = F.when(n > 1, F.stddev_samp(score).over(_w(group))).otherwise(1.0)
    d = F.col(score) - mean
    return df.withColumn("advantage", d / (std + EPS) if by_std else d)


@register("grpo_vectorized")
def grpo_vectorized(df: DataFrame, group: str, score: str, floor: float = 1e-6, **_) -> DataFrame:
    """As grpo, with the variance held above a floor before the root."""
    n = F.count(score).over(_w(group))
    mean = F.when(n > 1, F.avg(score).over(_w(group))).otherwise(0.0)
    std = F.when(n > 1, F.sqrt(F.greatest(F.var_samp(score).over(_w(group)), F.lit(floor)))).otherwise(1.0)
    return df.withColumn("advantage", (F.col(score) - mean) / (std + EPS))


@register("grpo_passk")
def grpo_passk(df: DataFrame, group: str, score: str, order: str, by_std: bool = True, **_) -> DataFrame:
    """The best response gets its lead over the second, the others 0; a group of one raises."""
    w = _w(group)
    ranked = w.orderBy(F.desc(score), order)
    n = F.count(score).over(w)
    second = F.nth_value(score, 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = F.col(score) - second
    std = F.stddev_samp(score).over(w) + EPS if by_std else F.lit(1.0)
    out = F.when(n < 2, F.raise_error(F.lit("a group of one has no second response")).cast("double")).when(F.row_number().over(ranked) == 1, lead / std).otherwise(0.0)
    return df.withColumn("advantage", out)


@register("rloo")
def rloo(df: DataFrame, group: str, score: str, **_) -> DataFrame:
    """Score less the mean of the others; a single response keeps its score."""
    n, mean = F.count(score).over(_w(group)), F.avg(score).over(_w(group))
    return df.withColumn("advantage", F.when(n > 1, F.col(score) * n / (n - 1) - mean * n / (n - 1)).otherwise(F.col(score)))


@register("rloo_vectorized")
def rloo_vectorized(df: DataFrame, group: str, score: str, **_) -> DataFrame:
    """As rloo, but a single response gets 0."""
    n, total = F.count(score).over(_w(group)), F.sum(score).over(_w(group))
    return df.withColumn("advantage", F.when(n > 1, F.col(score) - (total - F.col(score)) / (n - 1)).otherwise(0.0))


@register("opo")
def opo(df: DataFrame, group: str, score: str, length: str, **_) -> DataFrame:
    """Score less the length-weighted mean; a single response keeps its score."""
    w = _w(group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.when(F.count(score).over(w) > 1, F.col(score) - base).otherwise(F.col(score)))


def _whiten(df: DataFrame, raw: str, weight: str | None) -> DataFrame:
    """(x - mean) / sqrt(var + 1e-8) over all rows, weighted; the statistics are one small row."""
    wt = F.col(weight) if weight else F.lit(1.0)
    s = df.agg(F.sum(wt).alias("_n"), F.sum(wt * F.col(raw)).alias("_s"), F.sum(wt * F.col(raw) * F.col(raw)).alias("_q"))
    s = s.select((F.col("_s") / F.col("_n")).alias("_mean"), ((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)).alias("_var"))
    return df.join(F.broadcast(s)).withColumn("advantage", (F.col(raw) - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8)).drop("_mean", "_var", raw)


@register("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(df: DataFrame, group: str, score: str, length: str | None = None, **_) -> DataFrame:
    """Score less the group mean, whitened over all tokens."""
    n = F.count(score).over(_w(group))
    return _whiten(df.withColumn("_raw", F.col(score) - F.when(n > 1, F.avg(score).over(_w(group))).otherwise(0.0)), "_raw", length)


@register("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, score: str, length: str | None = None, **_) -> DataFrame:
    """Returns at an undiscounted outcome, whitened over all tokens."""
    return _whiten(df.withColumn("_raw", F.col(score)), "_raw", length)


@register("remax")
def remax(df: DataFrame, score: str, baseline: str, **_) -> DataFrame:
    """Outcome less the outcome of the greedy response."""
    return df.withColumn("advantage", F.col(score) - F.col(baseline))


@register("gpg")
def gpg(df: DataFrame, group: str, score: str, norm: float = 1.0, **_) -> DataFrame:
    """alpha * (s - mean) / norm; alpha is all responses over those with a score."""
    a = df.agg((F.count("*") / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("_alpha"))
    n = F.count(score).over(_w(group))
    mean = F.when(n > 1, F.avg(score).over(_w(group))).otherwise(0.0)
    return df.withColumn("_d", F.col(score) - mean).join(F.broadcast(a)).withColumn("advantage", F.col("_alpha") * F.col("_d") / norm).drop("_alpha", "_d")


@register("gae")
def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float = 1.0, lam: float = 1.0, **_) -> DataFrame:
    """Advantages of token arrays by the masked reverse recurrence."""
    from trajecta.functions import arrays

    return df.withColumn("advantage", arrays.gae(F.col(rewards), F.col(values), F.col(mask), gamma, lam))


def family_lift(df: DataFrame, family: str, variant: str, score: str, raw: str = "raw", clip: float = 1.0) -> DataFrame:
    """Mean score of each variant less that of the raw variant of its family, clipped; 0 and uncovered without one."""
    by = df.groupBy(family, variant).agg(F.avg(score).alias("variant_mean"))
    base = F.avg(F.when(F.col(variant) == raw, F.col("variant_mean"))).over(_w(family))
    lift = F.greatest(F.least(F.col("variant_mean") - base, F.lit(clip)), F.lit(-clip))
    return by.select(family, variant, "variant_mean", F.coalesce(lift, F.lit(0.0)).alias("lift"), base.isNotNull().alias("covered"))
