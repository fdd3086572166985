"""Metrics of batches and evaluations: two-level aggregates over samples and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_name(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Reduce each key's values by its name: "max" anywhere means the maximum, then "min", else the mean."""
    g = df.groupBy(key).agg(F.max(value).alias("a"), F.min(value).alias("b"), F.avg(value).alias("c"))
    return g.select(key, F.when(F.col(key).contains("max"), F.col("a")).when(F.col(key).contains("min"), F.col("b")).otherwise(F.col("c")).alias("value"))


def masked(df: DataFrame, value: str, mask: str) -> DataFrame:
    """Sum, mean (over the mask plus 1e-8) and Bessel-corrected variance of masked values, as one row; a mask of 0 or 1 raises."""
    m, v = F.col(mask), F.col(value)
    s = df.agg(F.sum(m).alias("n"), F.sum(F.when(m != 0, v * m)).alias("s"), F.sum(F.when(m != 0, v * v * m)).alias("q"))
    mean = F.col("s") / (F.col("n") + 1e-8)
    var = F.when(F.col("n") <= 1, F.raise_error(F.lit("variance of fewer than two values")).cast("double")).otherwise((F.col("q") - 2 * mean * F.col("s") + mean * mean * F.col("n")) / (F.col("n") - 1))
    return s.select(F.col("s").alias("masked_sum"), mean.alias("masked_mean"), var.alias("masked_var"))


def group_stats(df: DataFrame, group: str, score: str, floor: float = 1e-6) -> DataFrame:
    """Mean and floored std of each group; a single row gives (0, 1)."""
    g = df.groupBy(group).agg(F.count(score).alias("n"), F.avg(score).alias("m"), F.var_samp(score).alias("v"))
    return g.select(group, "n", F.when(F.col("n") > 1, F.col("m")).otherwise(0.0).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("v"), F.lit(floor)))).otherwise(1.0).alias("std"))


def group_rewards(df: DataFrame, group: str, score: str) -> DataFrame:
    """Shares of groups without and with a positive score, positives and sizes of groups, as one row."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(score) > 0).alias("p"), F.sum(score).alias("s"), F.bool_and(F.col(score) == 0).alias("zero"))
    return g.agg(F.avg(F.col("zero").cast("double")).alias("all_zero_rate"), F.avg((F.col("p") > 0).cast("double")).alias("any_positive_rate"), F.avg("p").alias("positives_mean"), F.max("p").alias("positives_max"), F.avg("s").alias("reward_sum_mean"), F.avg("n").alias("size_mean"), F.min("n").alias("size_min"), F.max("n").alias("size_max"))


def data_metrics(df: DataFrame, score: str, length: str, limit: int, value: str, ret: str) -> DataFrame:
    """Extremes and means of scores and lengths, share cut at the limit, share aborted, explained variance."""
    aggs: list[Column] = []
    for c in (score, length):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")]
    aggs += [F.avg((F.col(length) >= limit).cast("double")).alias("clip_ratio"), F.avg((F.col(length) == 0).cast("double")).alias("aborted_ratio"), (1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)).alias("explained_var")]
    return df.agg(*aggs)


def pass_at_k(df: DataFrame, task: str, success: str, ks: list[int]) -> DataFrame:
    """n, c and pass@k of each task (null where it has fewer than k samples)."""
    from trajecta.functions.arrays import pass_at_k as at

    g = df.groupBy(task).agg(F.count("*").alias("n"), F.count_if(F.col(success)).alias("c"))
    return g.select(task, "n", "c", *[at(F.col("n"), F.col("c"), k).alias(f"pass_at_{k}") for k in ks])


def majority(df: DataFrame, group: str, vote: str, value: str, order: str) -> DataFrame:
    """The most frequent vote of each group and the value of its first row; ties go to the vote seen first."""
    v = df.groupBy(group, vote).agg(F.count("*").alias("votes"), F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("f"))
    best = v.groupBy(group).agg(F.min(F.struct((-F.col("votes")).alias("k"), F.col("f")["o"].alias("o"), F.col(vote).alias("vote"), F.col("f")["v"].alias("value"))).alias("b"))
    return best.select(group, F.col("b.vote").alias("vote"), F.col("b.value").alias("value"), (-F.col("b.k")).alias("votes"))


def validation(df: DataFrame, source: str, uid: str, value: str) -> DataFrame:
    """mean@N, population std@N, best and worst of each uid, averaged by source."""
    per = df.groupBy(source, uid).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.max(value).alias("b"), F.min(value).alias("w"), F.count("*").alias("n"))
    return per.groupBy(source).agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.avg("b").alias("best"), F.avg("w").alias("worst"), F.max("n").alias("n_max"), F.count("*").alias("n_uid"))


def bootstrap(df: DataFrame, group: str, value: str, order: str, size: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and std over resamples (with replacement, by hash) of the best and worst of ``size`` values of each group.

    A group's values are numbered and each draw picks by number, so a group is
    never gathered; draws are rows and spread over the cluster.
    """
    w = Window.partitionBy(group)
    rows = df.select(group, F.col(value).alias("v"), (F.row_number().over(w.orderBy(order)) - 1).alias("i"))
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    picks = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    picks = picks.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), group, "draw", "k"), F.col("n")).cast("int"))
    got = picks.join(rows, [group, "i"]).groupBy(group, "draw").agg(F.max("v").alias("b"), F.min("v").alias("w"))
    return got.groupBy(group).agg(F.avg("b").alias("best_mean"), F.stddev_pop("b").alias("best_std"), F.avg("w").alias("worst_mean"), F.stddev_pop("w").alias("worst_std"))


def eval_summary(df: DataFrame, dims: list[str], reward: str, success: str, error: str) -> DataFrame:
    """Counts and means overall and for each dimension, by grouping sets; error rows count but aren't averaged."""
    ok = F.col(error).isNull()
    aggs = [F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.avg(F.when(ok, F.col(reward))).alias("avg_reward"), F.avg(F.when(ok, F.col(success).cast("double"))).alias("success_rate")]
    return df.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(*aggs)


def throughput(df: DataFrame, tokens: str, seconds: str, gpus: int) -> DataFrame:
    return df.agg(F.sum(tokens).alias("total_tokens"), F.sum(seconds).alias("time"), (F.sum(tokens) / (F.sum(seconds) * gpus)).alias("throughput"), (F.sum(seconds) * 1000 / F.sum(tokens)).alias("ms_per_token"))


def slowest(df: DataFrame, gen: str, tool: str, attrs: list[str]) -> DataFrame:
    """Extremes and means of the timings, and the attributes of the slowest sample."""
    t = F.col(gen) + F.col(tool)
    best = F.max_by(F.struct(*attrs), F.struct(t, *[-F.col(a) for a in attrs[:1]]))
    return df.agg(F.min(gen).alias("gen_min"), F.max(gen).alias("gen_max"), F.avg(gen).alias("gen_mean"), F.min(tool).alias("tool_min"), F.max(tool).alias("tool_max"), F.avg(tool).alias("tool_mean"), best.alias("s")).select("*", *[F.col("s")[a].alias(f"slowest_{a}") for a in attrs]).drop("s")


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often (NaN equals NaN, null equals null)."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def source_means(df: DataFrame, source: str, row: str, score: str) -> DataFrame:
    """Mean over the responses of each row, then over the rows of each source."""
    per = df.groupBy(source, row).agg(F.avg(score).alias("_m"))
    return per.groupBy(source).agg(F.avg("_m").alias("test_score"), F.count("*").alias("rows"))


def episode_means(df: DataFrame, columns: list[str], success: str, groups: dict[str, str]) -> DataFrame:
    """Mean of each column without nulls and NaN, and of success where a group's flag is over 0.5, as one row; a column or group without numbers gives null."""
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    own = [F.avg(x(c)).alias(c) for c in columns]
    return df.agg(*own, *[F.avg(F.when(x(flag) > 0.5, x(success))).alias(f"{success}_{name}_mean") for name, flag in groups.items()])


def category_rank(c: Column, order: list[str]) -> Column:
    """Place of a category in the fixed order; unknown and missing ones come after all others."""
    at = F.array_position(F.array(*map(F.lit, order)), F.coalesce(c, F.lit(""))).cast("int")
    return F.when(at > 0, at - 1).otherwise(len(order))


def level_rank(c: Column) -> Column:
    """The number after the last underscore of a level's name; names without one come last."""
    return F.coalesce(F.element_at(F.split(c, "_"), -1).try_cast("bigint"), F.lit(10**9).cast("bigint"))


def aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the columns of either; numbers that one lacks are 0 there, and other columns null."""
    number = ("int", "bigint", "double", "float", "smallint", "tinyint")

    def fill(df: DataFrame, other: DataFrame) -> DataFrame:
        lack = [f for f in other.schema.fields if f.name not in df.columns]
        return df.withColumns({f.name: (F.lit(0) if f.dataType.simpleString() in number else F.lit(None)).cast(f.dataType) for f in lack}) if lack else df

    return fill(old, new).unionByName(fill(new, old))


def unique_key(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows; a key that stands twice, or is null, raises."""
    n = df.groupBy(*key).agg(F.count("*").alias("_n"))
    bad = (F.col("_n") > 1)
    for k in key:
        bad = bad | F.col(k).isNull()
    ok = n.where(F.when(bad, F.raise_error(F.lit("key is null or not unique")).cast("boolean")).otherwise(F.lit(True)))
    return df.join(ok.select(*key), key)
