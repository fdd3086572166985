"""Token sequences: ``events`` by user and time; ``value`` is the entropy or reward, the day is the turn."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trajecta.functions import arrays as A
from trajecta.operators import cuts
from trajecta.plans.base import plan, table

PLANS: dict = {}
ORDER = ["ts", "event_id"]
SMOOTH = """with s as (select *, row_number() over w pos, avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 5 following) sm, day(ts) turn from events window w as (partition by user_id order by ts, event_id)),
c as (select *, coalesce(abs(sm - lag(sm) over (partition by user_id order by pos)), 0) ch from s)"""


def tokens(s, d):
    return table(s, d, "events").withColumn("turn", F.dayofmonth("ts"))


@plan(PLANS, f"{SMOOTH}, b as (select *, row_number() over (partition by user_id, turn order by ch desc, pos) rb from c), k as (select *, row_number() over (partition by user_id order by ch desc, pos) r from b where rb = 1) select user_id, cast(user_id as varchar) || '__change_w11_k3__r' || r candidate_uid, turn, pos, r candidate_rank, round(sm, 6) smooth, round(ch, 6) change from k where r <= 3")
def change_topk_cuts(s, d):
    x = cuts.change_topk(tokens(s, d), "user_id", ORDER, "value", "turn")
    return x.withColumns({"smooth": F.round("smooth", 6), "change": F.round("change", 6)})


@plan(PLANS, "with s as (select *, row_number() over (partition by user_id order by ts, event_id) pos, day(ts) turn from events), b as (select *, row_number() over (partition by user_id, turn order by value desc, pos) rb from s), k as (select *, row_number() over (partition by user_id order by value desc, pos) r from b where rb = 1) select user_id, turn, pos, r candidate_rank, value score from k where r <= 3")
def raw_topk_cuts(s, d):
    return cuts.raw_topk(tokens(s, d), "user_id", ORDER, "value", "turn")


@plan(PLANS, f"{SMOOTH} select event_id, pos, round(sm, 6) smooth, round(ch, 6) change from c")
def centered_smoothing(s, d):
    return cuts.smoothed(table(s, d, "events"), "user_id", ORDER, "value").select("event_id", "pos", F.round("smooth", 6).alias("smooth"), F.round("change", 6).alias("change"))


@plan(PLANS, "with r as (select *, avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) ro, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) select event_id, round(ro, 6) rolling, round(avg(case when k <= 10 then value end) over (partition by user_id), 6) tail_mean from r")
def rolling_means(s, d):
    return cuts.rolling(table(s, d, "events"), "user_id", ORDER, "value", 5, 10).select("event_id", F.round("rolling", 6).alias("rolling"), F.round("tail_mean", 6).alias("tail_mean"))


def sequences(s, d):
    """One row for each user: arrays of values, of rewards and a mask by event type, in order of time."""
    e = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value", "event_type"))).alias("e"))
    v = F.transform("e", lambda x: x["value"] / 100)
    return e.select("user_id", v.alias("r"), F.transform("e", lambda x: (x["event_id"] % 7) / 10.0).alias("v"), F.transform("e", lambda x: (x["event_type"] != "view").cast("double")).alias("m"))


REV = "with recursive t as (select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) k, event_id, value / 100 r, (event_id % 7) / 10.0 v, case when event_type <> 'view' then 1.0 else 0.0 end m from events)"


@plan(PLANS, f"{REV}, g as (select user_id, k, event_id, case when m = 1 then r - v else 0.0::double end last, case when m = 1 then v else 0.0::double end nxt from t where k = 1 union all select t.user_id, t.k, t.event_id, case when m = 1 then r + 0.9 * nxt - v + 0.9 * 0.8 * last else last end, case when m = 1 then v else nxt end from g join t on t.user_id = g.user_id and t.k = g.k + 1) select user_id, count(*) n, round(sum(last), 4) total, round(max(last), 5) top from g group by 1")
def gae_advantages(s, d):
    x = sequences(s, d).withColumn("a", A.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8))
    return x.select("user_id", F.size("a").cast("long").alias("n"), F.round(A.array_sum(F.col("a")), 4).alias("total"), F.round(F.array_max("a"), 5).alias("top"))


@plan(PLANS, f"{REV}, g as (select user_id, k, m, r::double run from t where k = 1 union all select t.user_id, t.k, t.m, t.r + 0.9 * (g.run * g.m) from g join t on t.user_id = g.user_id and t.k = g.k + 1) select user_id, round(sum(run), 4) total, round(max(run), 5) top from g group by 1")
def discounted_returns(s, d):
    x = sequences(s, d).withColumn("a", A.discounted_returns(F.col("r"), F.col("m"), 0.9))
    return x.select("user_id", F.round(A.array_sum(F.col("a")), 4).alias("total"), F.round(F.array_max("a"), 5).alias("top"))


@plan(PLANS, f"{REV}, c as (select user_id, sum(r * m) over (partition by user_id order by k) run from t) select user_id, round(max(run), 5) top, round(sum(run), 4) total from c group by 1")
def reverse_cumulative_sums(s, d):
    x = sequences(s, d).withColumn("a", A.reverse_cumsum(F.col("r"), F.col("m")))
    return x.select("user_id", F.round(F.array_max("a"), 5).alias("top"), F.round(A.array_sum(F.col("a")), 4).alias("total"))


@plan(PLANS, "select user_id, round(sum(case when event_type <> 'view' then value / 100 else 0 end), 4) masked_sum, round(sum(case when event_type <> 'view' then value / 100 else 0 end) / (count(*) filter (event_type <> 'view') + 1e-8), 6) masked_mean from events group by 1")
def masked_sequence_mean(s, d):
    return sequences(s, d).select("user_id", F.round(A.masked_sum(F.col("r"), F.col("m")), 4).alias("masked_sum"), F.round(A.masked_mean(F.col("r"), F.col("m")), 6).alias("masked_mean"))


@plan(PLANS, "with p as (select l_orderkey k, list(l_linenumber order by l_linenumber) ids, count(*) n from lineitem group by 1) select k, [case when i <= case when list_position(ids, 3) is null or list_position(ids, 3) = 0 then n else list_position(ids, 3) end then 1 else 0 end for i in range(1, n + 1)] mask, [greatest(least(i, case when list_position(ids, 3) is null or list_position(ids, 3) = 0 then n else list_position(ids, 3) end) - 1, 0) for i in range(1, n + 1)] positions from p")
def response_masks(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    x = x.withColumn("mask", A.response_mask(F.col("ids"), 3))
    return x.select("k", "mask", A.position_ids(F.col("mask")).alias("positions"))


@plan(PLANS, "with p as (select l_orderkey k, list(l_linenumber order by l_linenumber) ids, count(*) n from lineitem group by 1) select k, list_concat(ids, [0 for i in range(0, greatest(7 - n, 0))]) padded, list_concat([0 for i in range(0, greatest(7 - n, 0))], ids) left_padded, case when n > 2 then ids[n - 1:n] else ids end cut_left, case when n > 2 then [ids[1], ids[n]] else ids end cut_middle from p")
def pad_and_truncate(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    i = F.col("ids")
    return x.select("k", A.pad(i, 7, F.lit(0)).alias("padded"), A.pad(i, 7, F.lit(0), left=True).alias("left_padded"), A.truncate(i, 2, "left").alias("cut_left"), A.truncate(i, 2, "middle").alias("cut_middle"))


@plan(PLANS, "select o_orderkey k, [cast((i >= 1 and i < 3) or (i >= 5 and i < 6) as int) for i in range(0, o_orderkey % 8)] mask from orders")
def span_masks(s, d):
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("start"), F.lit(6).alias("end")))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), A.span_mask((F.col("o_orderkey") % 8).cast("int"), spans).alias("mask"))


def _spans(s, d):
    """Purchases as spans of 500 ids from their own id on."""
    return table(s, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 500).alias("end"), F.col("event_id").alias("name"))


@plan(PLANS, "with s as (select user_id, event_id b, event_id + 500 e from events where event_type = 'purchase'), v as (select event_id, user_id from events where event_type = 'view') select v.event_id, coalesce(min(b) filter (b <= event_id and event_id < e), max(b) filter (e <= event_id), min(b)) span, case when count(*) filter (b <= event_id and event_id < e) > 0 then 'contained' when count(*) filter (e <= event_id) > 0 then 'previous' when count(b) > 0 then 'first' end policy, case when count(*) filter (b <= event_id and event_id < e) > 0 then 0 when count(*) filter (e <= event_id) > 0 then event_id - max(e) filter (e <= event_id) + 1 else min(b) - event_id end distance from v left join s on s.user_id = v.user_id group by 1")
def nearest_spans(s, d):
    p = table(s, d, "events").where("event_type = 'view'").select("event_id", "user_id")
    return cuts.nearest_span(p, _spans(s, d), "user_id", "event_id", "start", "end", "name").select("event_id", "span", "policy", F.col("distance").cast("long").alias("distance"))


@plan(PLANS, "with s as (select user_id, event_id b, event_id + 40 e, cast(event_id as int) n from events where event_type = 'purchase'), v as (select event_id, user_id from events where event_type = 'view'), j as (select v.event_id, n, case when v.event_id between b and e - 1 then 0 when v.event_id < b then b - v.event_id else v.event_id - e + 1 end far, b from v left join s on s.user_id = v.user_id), r as (select *, row_number() over (partition by event_id order by far, case when far = 0 then b end, n) k from j) select event_id, n span, case when far = 0 then 'contained' when far is not null then 'nearest' end policy, far distance from r where k = 1")
def nearest_spans_by_distance(s, d):
    e = table(s, d, "events")
    sp = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("end"), F.col("event_id").cast("int").alias("name"))
    p = e.where("event_type = 'view'").select("event_id", "user_id")
    return cuts.nearest_span(p, sp, "user_id", "event_id", "start", "end", "name", policy="nearest").select("event_id", "span", "policy", "distance")


@plan(PLANS, "with s as (select user_id, event_id span, event_id s, event_id + 500 e from events where event_type = 'purchase'), t as (select user_id, event_id token, event_id - 100 cs, event_id + 100 ce from events) select s.user_id, span, min(token) token_start, max(token) + 1 token_end from s join t on s.user_id = t.user_id and cs < e and ce > s group by 1, 2")
def span_token_overlap(s, d):
    sp = _spans(s, d).select("user_id", F.col("name").alias("span"), F.col("start").alias("s"), F.col("end").alias("e"))
    tk = table(s, d, "events").select("user_id", F.col("event_id").alias("token"), (F.col("event_id") - 100).alias("cs"), (F.col("event_id") + 100).alias("ce"))
    return cuts.overlap(tk, sp, "user_id")


@plan(PLANS, "select event_type, time_bucket(interval 1 hour, ts) start, count(*) n, round(sum(value), 2) total from events group by 1, 2")
def hourly_windows(s, d):
    """Extension: the batch form of the streaming window."""
    e = table(s, d, "events")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


@plan(PLANS, "with g as (select *, coalesce(date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) > 6 * 3600000000, true) f from events), k as (select *, sum(cast(f as int)) over (partition by user_id order by ts, event_id) sess from g) select user_id, sess session, count(*) n, round(sum(value), 2) total from k group by 1, 2")
def gap_sessions(s, d):
    """Extension: sessions parted by six quiet hours."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w) > 6 * 3600000000
    x = table(s, d, "events").withColumn("f", F.coalesce(gap, F.lit(True)).cast("int"))
    return x.withColumn("session", F.sum("f").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
