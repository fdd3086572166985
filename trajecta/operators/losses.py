"""Values of policy losses, importance weights and their diagnostics, from token log-probabilities in long form.

Every policy loss takes ``mask`` (tokens of mask 0 or null don't enter sums,
means or choices; their own loss is still given, for ``aggregate`` to leave
out) and ``weight``, the token weights of a rollout correction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def put(f):
        LOSSES[name] = f
        return f

    return put


def held(x: Column, bound: float = 20.0) -> Column:
    """Between -bound and bound; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(bound)), F.lit(-bound)))


def ratio(new: Column, old: Column) -> Column:
    return F.exp(held(new - old))


def valid(mask: str | None) -> Column:
    return F.lit(True) if mask is None else F.coalesce(F.col(mask) > 0, F.lit(False))


def weighed(loss: Column, weight: str | None) -> Column:
    return loss if weight is None else loss * F.col(weight)


def clipped_pair(r: Column, a: Column, low: float, high: float) -> tuple[Column, Column]:
    """The plain surrogate and the one with the ratio held inside its bounds."""
    return -a * r, -a * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low))


@register("vanilla")
def vanilla(df: DataFrame, new: str, old: str, adv: str, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """Dual-clip loss of each token, with flags for the upper and lower clip."""
    if dual <= 1:
        raise ValueError("the dual clip must be over 1")
    a = F.col(adv)
    plain, cut = clipped_pair(ratio(F.col(new), F.col(old)), a, low, high)
    worst, bound = F.greatest(plain, cut), -a * dual
    flag = lambda c: (c & valid(mask)).cast("int")
    return df.withColumns({"loss": weighed(F.when(a < 0, F.least(worst, bound)).otherwise(worst), weight), "clipped": flag(cut > plain), "clipped_low": flag((worst > bound) & (a < 0))})


@register("gspo")
def gspo(df: DataFrame, new: str, old: str, adv: str, seq: str = "seq", low: float = 3e-4, high: float = 4e-4, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """The ratio is that of the whole sequence: the exponential of its mean log-ratio over valid tokens, at most 10 in the exponent."""
    w = Window.partitionBy(seq)
    mean = F.coalesce(F.avg(F.when(valid(mask), F.col(new) - F.col(old))).over(w), F.lit(0.0))
    plain, cut = clipped_pair(F.exp(F.least(mean, F.lit(10.0))), F.col(adv), low, high)
    return df.withColumns({"loss": weighed(F.greatest(plain, cut), weight), "clipped": ((cut > plain) & valid(mask)).cast("int")})


@register("gpg")
def gpg(df: DataFrame, new: str, old: str | None, adv: str, mask: str | None = None, weight: str | None = None) -> DataFrame:
    return df.withColumn("loss", weighed(-F.col(new) * F.col(adv), weight))


@register("geo_mean")
def geo_mean(df: DataFrame, new: str, old: str, adv: str, seq: str = "seq", clip: float = 0.4, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """One loss for each sequence: the geometric mean of clipped token ratios times the mean advantage, over valid tokens.

    Token weights enter by their geometric mean; a sequence without valid tokens has loss 0.
    """
    d, s, ok = F.col(new) - F.col(old), F.signum(F.col(adv)), valid(mask)
    kept = s * F.least(s * d, s * F.greatest(F.least(d, F.lit(clip)), F.lit(-clip)))
    n = F.count_if(ok) + 1e-8
    over = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0.0)) / n
    aggs = [F.exp(over(kept)).alias("_r"), over(F.col(adv)).alias("_a"), (F.lit(1.0) if weight is None else F.exp(over(F.log(F.col(weight) + 1e-10)))).alias("_w")]
    return df.groupBy(seq).agg(*aggs).select(seq, (-F.col("_a") * F.col("_r") * F.col("_w")).alias("loss"))


def covariance(df: DataFrame, new: str, adv: str, mask: str | None) -> DataFrame:
    """``cov`` of each token: its advantage times its log-probability, each less its mean over valid tokens; ``_n`` valid tokens."""
    ok = valid(mask)
    m = df.agg(F.avg(F.when(ok, F.col(adv))).alias("_ma"), F.avg(F.when(ok, F.col(new))).alias("_ml"), F.count_if(ok).alias("_n"))
    return df.join(F.broadcast(m)).withColumn("cov", (F.col(adv) - F.col("_ma")) * (F.col(new) - F.col("_ml"))).drop("_ma", "_ml")  # one row


def chosen(df: DataFrame, rule: Column, order: dict[str, Column], share: float, least: int = 1) -> DataFrame:
    """``picked``: 1 for the first max(least, share * _n) rows that meet the rule, by the given order.

    Rows that meet it are put in order by range partitions and numbered there,
    so a number that grows with the table is no matter.
    """
    from trajecta.operators.batch import with_ordinal

    met = F.coalesce(rule, F.lit(False))
    some = with_ordinal(df.where(met).withColumns({f"_o{i}": c for i, c in enumerate(order.values())}), [f"_o{i}" for i in range(len(order))], "_at").drop(*[f"_o{i}" for i in range(len(order))])
    some = some.withColumn("picked", (F.col("_at") < F.greatest(F.floor(F.col("_n") * share), F.lit(least))).cast("int")).drop("_at")
    return some.unionByName(df.where(~met).withColumn("picked", F.lit(0))).drop("_n")


def keys_of(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


@register("kl_cov")
def kl_cov(df: DataFrame, new: str, old: str, adv: str, order: str | list[str] = ("seq", "pos"), share: float = 0.0002, coef: float = 1.0, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """The valid tokens of largest covariance (a share of them, one at least; ties by ``order``) get a KL penalty."""
    if share <= 0:
        raise ValueError("the share must be over 0")
    d = F.col(new) - F.col(old)
    c = chosen(covariance(df, new, adv, mask), valid(mask), {"cov": -F.round("cov", 9)} | {k: F.col(k) for k in keys_of(order)}, share)
    return c.withColumn("loss", weighed(-F.col(adv) * F.exp(d) + F.when(F.col("picked") == 1, coef * F.abs(d)).otherwise(0.0), weight))


@register("clip_cov")
def clip_cov(df: DataFrame, new: str, old: str, adv: str, key: str | list[str] = ("seq", "pos"), low: float = 1.0, high: float = 5.0, share: float = 0.0002, clip_low: float = 0.2, clip_high: float = 0.2, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """Clipped loss of each token; of the valid tokens that the clip leaves alone and whose covariance lies between the bounds, a share of all (one at least) by hash of their key lose their gradient (loss 0)."""
    if share <= 0:
        raise ValueError("the share must be over 0")
    plain, cut = clipped_pair(F.exp(F.col(new) - F.col(old)), F.col(adv), clip_low, clip_high)
    inside = valid(mask) & ~(cut > plain) & (F.col("cov") > low) & (F.col("cov") < high)
    keys = keys_of(key)
    h = F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).cast("binary"))
    c = chosen(covariance(df, new, adv, mask), inside, {"h": h} | {k: F.col(k) for k in [*keys, adv, new]}, share)
    return c.withColumn("loss", weighed(F.greatest(plain, cut) * (1 - F.col("picked")), weight))


@register("drpo")
def drpo(df: DataFrame, group: str, score: str, new: str, length: str, tau: float = 10.0, lam: float = 5000.0, eps: float = 1e-8) -> DataFrame:
    """One loss for each group of sequences with both right and wrong ones; others drop out.

    Right sequences are weighted by exp((1 - length) / lam); the wrong ones enter
    by the sum of exp(s / tau) over itself plus eps.
    """
    right, s = F.col(score) > 0, F.col(new)
    w = F.when(right, F.exp((1 - F.col(length)) / lam))
    wrong = F.when(~right, F.exp(s / tau))
    g = df.groupBy(group).agg(F.count_if(right).alias("n_right"), F.count("*").alias("n"), (F.sum(F.when(right, w * s)) / F.sum(w)).alias("_r"), (F.sum(wrong * s) / (F.sum(wrong) + eps)).alias("_w"))
    return g.where((F.col("n_right") > 0) & (F.col("n_right") < F.col("n"))).select(group, "n_right", "n", (F.col("_w") - F.col("_r")).alias("loss"))


def aggregate(df: DataFrame, loss: str, seq: str, mask: str, mode: str, horizon: int = 1) -> DataFrame:
    """token-mean, seq-mean-token-sum, seq-mean-token-mean or seq-mean-token-sum-norm, as one row."""
    m = F.col(mask)
    per = df.groupBy(seq).agg(F.sum(F.when(m != 0, F.col(loss) * m)).alias("s"), F.sum(m).alias("n"))
    if mode == "token-mean":
        return per.agg((F.sum("s") / F.sum("n")).alias("loss"))
    per = per.where("n > 0")
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.col("s") / F.col("n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / horizon).alias("loss"))
    raise ValueError(f"no mode named {mode}")


def value_loss(df: DataFrame, pred: str, old: str, ret: str, clip: float) -> DataFrame:
    """Clipped squared error of values and whether the clip took effect."""
    p = F.greatest(F.least(F.col(pred), F.col(old) + clip), F.col(old) - clip)
    a, b = F.pow(F.col(pred) - F.col(ret), 2), F.pow(p - F.col(ret), 2)
    return df.withColumns({"loss": 0.5 * F.greatest(a, b), "clipped": (b > a).cast("int")})


def importance_weights(df: DataFrame, new: str, old: str, seq: str, level: str = "token", cap: float = 2.0) -> DataFrame:
    """Truncated weights by token, sequence (product) or geometric mean of the sequence."""
    d = F.col(new) - F.col(old)
    w = Window.partitionBy(seq)
    x = {"token": d, "sequence": F.sum(d).over(w), "geometric": F.avg(d).over(w)}[level]
    raw = F.exp(F.greatest(F.least(x, F.lit(20.0)), F.lit(-20.0)))
    return df.withColumns({"raw_weight": raw, "weight": F.least(raw, F.lit(cap))})


def rejection(df: DataFrame, new: str, old: str, seq: str, low: float, high: float, veto: float) -> DataFrame:
    """Sequences kept: geometric ratio inside the bounds and no token under the veto ratio."""
    d = F.col(new) - F.col(old)
    return df.groupBy(seq).agg(F.exp(F.avg(d)).alias("ratio"), F.min(d).alias("_least")).select(seq, "ratio", ((F.col("ratio") >= low) & (F.col("ratio") <= high)).alias("in_bounds"), (F.col("_least") < F.log(F.lit(veto))).alias("vetoed"))


def corrected(df: DataFrame, new: str, old: str, seq: str, mask: str | None = None, level: str = "token", cap: float = 2.0, low: float = 0.5, high: float = 2.0, veto: float = 1e-4) -> DataFrame:
    """Rollout correction in one step: truncated ``weight`` of each token, and ``keep``, the mask without sequences whose geometric ratio is out of bounds or that hold a vetoed token.

    Ratios and vetoes are of valid tokens.
    """
    ok = valid(mask)
    d, w = F.when(ok, F.col(new) - F.col(old)), Window.partitionBy(seq)
    x = {"token": d, "sequence": F.sum(d).over(w), "geometric": F.avg(d).over(w)}[level]
    geo = F.exp(F.avg(d).over(w))
    kept = ok & (geo >= low) & (geo <= high) & (F.min(d).over(w) >= F.log(F.lit(veto)))
    return df.withColumns({"weight": F.when(ok, F.least(F.exp(held(x)), F.lit(cap))).otherwise(0.0), "keep": F.coalesce(kept, F.lit(False)).cast("int")})


def loss_metrics(df: DataFrame, new: str, old: str, mask: str | None = None) -> DataFrame:
    """Clip shares and the KL estimate over valid tokens, as one row; ``df`` is what a policy loss gave."""
    ok = valid(mask)
    flags = [F.avg(F.when(ok, F.col(c).cast("double"))).alias(n) for c, n in (("clipped", "clip_share"), ("clipped_low", "clip_share_low")) if c in df.columns]
    return df.agg(*flags, F.avg(F.when(ok, F.col(old) - F.col(new))).alias("ppo_kl"))


def weight_metrics(df: DataFrame, weight: str, low: float, high: float) -> DataFrame:
    """Mean, extremes, shares outside the bounds, std and effective sample size, as one row."""
    w = F.col(weight)
    m = df.agg(F.avg(w).alias("mean"), F.max(w).alias("max"), F.min(w).alias("min"), F.stddev_samp(w).alias("std"), F.avg((w > high).cast("double")).alias("share_high"), F.avg((w < low).cast("double")).alias("share_low"), F.avg(w * w).alias("_q"))
    return m.withColumn("ess", F.pow(F.col("mean") + 1e-8, 2) / F.col("_q")).drop("_q")


def off_policy(df: DataFrame, new: str, old: str, seq: str) -> DataFrame:
    """Perplexities, KL and chi-square of the two policies from per-sequence means, as one row."""
    d = F.col(new) - F.col(old)
    per = df.groupBy(seq).agg(F.avg(new).alias("n"), F.avg(old).alias("o"), F.sum(d).alias("sd"), F.avg(-d).alias("kl"), F.avg(F.exp(d) - d - 1).alias("k3"), F.avg(F.exp(2 * d)).alias("x2"))
    return per.agg(
        F.avg(F.exp(-F.col("n"))).alias("ppl"), F.avg(F.exp(-F.col("o"))).alias("rollout_ppl"), F.avg("kl").alias("kl"), F.avg("k3").alias("k3_kl"), F.avg(F.col("o") - F.col("n")).alias("log_ppl_diff"), F.max(F.abs(F.col("o") - F.col("n"))).alias("log_ppl_abs_diff_max"), F.avg(F.exp(F.col("o") - F.col("n"))).alias("ppl_ratio"), (F.avg("x2") - 1).alias("chi2_token")
    )
