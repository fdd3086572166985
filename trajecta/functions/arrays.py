"""Array columns: scans, masks, padding and spans, folded inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gae(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Advantages by the reverse recurrence; masked steps carry the state through."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("nxt"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        delta = x["r"] + gamma * s["nxt"] - x["v"]
        new = delta + gamma * lam * s["last"]
        return F.struct(F.when(x["m"] == 1, new).otherwise(s["last"]).alias("last"), F.when(x["m"] == 1, x["v"]).otherwise(s["nxt"]).alias("nxt"), F.concat(F.array(F.when(x["m"] == 1, new).otherwise(s["last"])), s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """R_t = r_t + gamma * R_{t+1}; a masked step resets the running return."""
    steps = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        now = x["r"] + gamma * s["run"]
        return F.struct((now * x["m"]).alias("run"), F.concat(F.array(now), s["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def reverse_cumsum(values: Column, mask: Column) -> Column:
    steps = F.reverse(F.zip_with(values, mask, lambda v, m: v * m))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(steps, start, lambda s, x: F.struct((s["run"] + x).alias("run"), F.concat(F.array(s["run"] + x), s["out"]).alias("out")), lambda s: s["out"])


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (array_sum(mask.cast("array<double>")) + 1e-8)


def response_mask(ids: Column, eos: int) -> Column:
    """1 up to the first end mark, with it; 0 after."""
    at = F.array_position(ids, eos)
    return F.when(F.size(ids) == 0, F.array().cast("array<int>")).otherwise(F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0)))


def position_ids(mask: Column) -> Column:
    """Running count of unmasked places less one, never under zero."""
    return F.transform(mask, lambda _, i: F.greatest(F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda a, x: a + x.cast("int")) - 1, F.lit(0)))


def pad(values: Column, length: int, fill: Column, left: bool = False) -> Column:
    extra = F.array_repeat(fill, F.greatest(F.lit(length) - F.size(values), F.lit(0)))
    return F.concat(extra, values) if left else F.concat(values, extra)


def truncate(values: Column, length: int, mode: str) -> Column:
    """left keeps the end, right the start, middle both; error raises."""
    n = F.size(values)
    half = length // 2
    cut = {
        "left": F.slice(values, n - length + 1, F.lit(length)),
        "right": F.slice(values, 1, length),
        "middle": F.concat(F.slice(values, 1, half), F.slice(values, n - (length - half) + 1, F.lit(length - half))),
        "error": F.raise_error(F.lit("sequence is longer than allowed")).cast("array<int>"),
    }[mode]
    return F.when(n > length, cut).otherwise(values)


def span_mask(length: Column, spans: Column) -> Column:
    """0/1 for each place: whether a half-open span holds it; empty for no places."""
    empty = F.array().cast("array<int>")
    return F.when(length <= 0, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])).cast("int")))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; null where n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None).cast("double")).when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def kl(log_prob: Column, ref: Column, kind: str) -> Column:
    """k1 (kl), abs, k2 (mse) and k3 (low_var_kl) estimators."""
    d = log_prob - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        x = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(x) - x - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"no estimator named {kind}")


def histogram(values: Column) -> Column:
    """map<value, count> of an array."""
    keys = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(values, lambda v: v == k))))


def diff_count(a: Column, b: Column, mask: Column) -> Column:
    """Places with mask 1 where the arrays differ; 0 where one is empty, and null where the lengths differ."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m"))
    n = F.size(F.filter(both, lambda x: (x["m"] == 1) & ~x["a"].eqNullSafe(x["b"])))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when((F.size(a) == F.size(b)) & (F.size(a) == F.size(mask)), n)
