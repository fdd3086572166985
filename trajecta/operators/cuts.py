"""Cut selection over token sequences: smoothing, change scores and best turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.sources.tables import cut


def smoothed(df: DataFrame, uid: str, order: list[str], value: str, window: int = 11) -> DataFrame:
    """Place in the sequence, centred moving average (cut at the ends) and the absolute change from the place before."""
    r = window // 2
    w = Window.partitionBy(uid).orderBy(*order)
    x = df.withColumns({"pos": F.row_number().over(w), "smooth": F.avg(value).over(w.rowsBetween(-r, r))})
    return x.withColumn("change", F.coalesce(F.abs(F.col("smooth") - F.lag("smooth").over(w)), F.lit(0.0)))


def best_turns(df: DataFrame, uid: str, turn: str, score: str, pos: str = "pos", k: int = 3) -> DataFrame:
    """The best place of each turn, ranked by score then place, and the first k turns.

    Two windows over the same key: Spark sorts each sequence once and cuts at k.
    """
    one = Window.partitionBy(uid, turn).orderBy(F.desc(score), pos)
    best = df.withColumn("_b", F.row_number().over(one)).where("_b = 1").drop("_b")
    w = Window.partitionBy(uid).orderBy(F.desc(score), pos)
    return best.withColumn("candidate_rank", F.row_number().over(w)).where(F.col("candidate_rank") <= k)


def change_topk(df: DataFrame, uid: str, order: list[str], value: str, turn: str, window: int = 11, k: int = 3) -> DataFrame:
    s = smoothed(df, uid, order, value, window)
    top = best_turns(s, uid, turn, "change", k=k)
    return top.select(uid, F.concat_ws("__", F.col(uid).cast("string"), F.lit(f"change_w{window}_k{k}"), F.concat(F.lit("r"), "candidate_rank")).alias("candidate_uid"), turn, "pos", "candidate_rank", "smooth", "change")


def raw_topk(df: DataFrame, uid: str, order: list[str], value: str, turn: str, k: int = 3) -> DataFrame:
    x = df.withColumn("pos", F.row_number().over(Window.partitionBy(uid).orderBy(*order)))
    return best_turns(x, uid, turn, value, k=k).select(uid, turn, "pos", "candidate_rank", F.col(value).alias("score"))


def rolling(df: DataFrame, uid: str, order: list[str], value: str, width: int, tail: int) -> DataFrame:
    """Rolling mean over the last ``width`` rows, and the mean of the last ``tail`` rows of each sequence."""
    w = Window.partitionBy(uid).orderBy(*order)
    back = Window.partitionBy(uid).orderBy(*[F.desc(c) for c in order])
    x = df.withColumns({"rolling": F.avg(value).over(w.rowsBetween(-(width - 1), 0)), "_r": F.row_number().over(back)})
    return x.withColumn("tail_mean", F.avg(F.when(F.col("_r") <= tail, F.col(value))).over(Window.partitionBy(uid))).drop("_r")


def with_running(df: DataFrame, key: str, order: list[str], high: str, low: str) -> DataFrame:
    """``high`` as its maximum over the rows of a key up to each row, and ``low`` as its minimum over the rows from there on.

    Rows are dealt out in ranges of key and order, so a long key lies in many
    ranges; each range carries in what the ranges of its key before and after it
    hold.  Both runs grow by one row at a time: the second one goes backwards.
    """
    x = cut(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    down = [F.desc(c) for c in order]
    sums = x.groupBy(F.col(key).alias("_sk"), F.col("_part").alias("_sp")).agg(F.max(high).alias("_sb"), F.min(low).alias("_sa"))
    earlier, later = (Window.partitionBy("_sk").orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in ("_sp", F.desc("_sp")))
    sums = sums.select("_sk", "_sp", F.max("_sb").over(earlier).alias("_cb"), F.min("_sa").over(later).alias("_ca"))
    up, back = (Window.partitionBy(key, "_part").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (order, down))
    x = x.withColumns({high: F.max(high).over(up), low: F.min(low).over(back)})
    x = x.join(sums, F.col(key).eqNullSafe(F.col("_sk")) & (F.col("_part") == F.col("_sp")))
    return x.withColumns({high: F.greatest(high, "_cb"), low: F.least(low, "_ca")}).drop("_sk", "_sp", "_cb", "_ca", "_part")


def nearest_span(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, policy: str = "previous", width: int = 256) -> DataFrame:
    """The first span that holds a point; else by policy the last one before it (the first of all, if none is), or the nearest (ties: the lower name), with how it was found and how far.

    Spans that hold a point are met in stretches of ``width`` places; for the
    others points and the ends of spans are sorted once, in ranges that a long
    key shares out.  Points of a key without
    spans get nulls.
    """
    if policy not in ("previous", "nearest"):
        raise ValueError(f"no policy named {policy}")
    s, e, n = F.col(start).cast("long"), F.col(end).cast("long"), F.col(name)
    wide = spans.where(e > s).select(F.col(key).alias("_k"), s.alias("_s"), e.alias("_e"), n.alias("_n"), F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width))).alias("_w"))
    spots = points.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_p")).distinct().withColumn("_w", F.floor(F.col("_p") / width))
    held = spots.join(wide, ["_k", "_w"]).where("_s <= _p and _p < _e").groupBy("_k", "_p").agg(F.min(F.struct(F.col("_s"), F.col("_n").alias("n")))["n"].alias("_in"))
    span = F.struct(s.alias("s"), e.alias("e"), n.alias("n"))
    ends = spans.select(F.col(key).alias("_k"), e.alias("_p"), F.lit(0).alias("_kind"), span.alias("_span"))
    starts = spans.select(F.col(key).alias("_k"), s.alias("_p"), F.lit(2).alias("_kind"), span.alias("_span"))
    own = points.select(F.col(key).alias("_k"), F.col(at).cast("long").alias("_p"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    over, under = F.when(F.col("_kind") == 0, F.col("_span")), F.when(F.col("_kind") == 2, F.col("_span"))
    last = over if policy == "previous" else F.when(F.col("_kind") == 0, F.struct(F.col("_span.e").alias("e"), (-F.col("_span.n")).alias("m")))
    x = with_running(ends.union(starts).unionByName(own, allowMissingColumns=True).withColumns({"_b": last, "_a": under}), "_k", ["_p", "_kind"], "_b", "_a").where("_kind = 1")
    x = x.join(held, ["_k", "_p"], "left")
    p, inside = F.col("_p"), F.col("_in").isNotNull()
    near_a = F.when(F.col("_a").isNotNull(), F.struct((F.col("_a.s") - p).alias("far"), F.col("_a.n").alias("n")))
    if policy == "previous":
        near_b = F.when(F.col("_b").isNotNull(), F.struct((p - F.col("_b.e") + 1).alias("far"), F.col("_b.n").alias("n")))
        best, how = F.coalesce(near_b, near_a), F.when(near_b.isNotNull(), "previous").when(near_a.isNotNull(), "first")
    else:
        near_b = F.when(F.col("_b").isNotNull(), F.struct((p - F.col("_b.e") + 1).alias("far"), (-F.col("_b.m")).alias("n")))
        best = F.least(near_b, near_a)
        how = F.when(best.isNotNull(), "nearest")
    return x.select("_row.*", F.when(inside, F.col("_in")).otherwise(best["n"]).alias("span"), F.when(inside, "contained").otherwise(how).alias("policy"), F.when(inside, F.lit(0).cast("long")).otherwise(best["far"]).alias("distance"))


def overlap(tokens: DataFrame, spans: DataFrame, key: str, width: int = 256) -> DataFrame:
    """First and last token (half-open) of each span: tokens [cs, ce) that overlap [s, e) of the same key.

    Both meet in stretches of ``width`` places, so a long key isn't one group and
    a token meets only the spans near it; a pair that meets twice counts once.
    """
    over = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    t = tokens.select(F.col(key).alias("_k"), "token", "cs", "ce", over("cs", "ce").alias("_w"))
    s = spans.select(key, "span", "s", "e", over("s", "e").alias("_w"))
    j = s.join(t, (s[key] == t["_k"]) & (s["_w"] == t["_w"]) & (t["cs"] < s["e"]) & (t["ce"] > s["s"]))
    return j.groupBy(s[key], "span").agg(F.min("token").alias("token_start"), (F.max("token") + 1).alias("token_end"))
