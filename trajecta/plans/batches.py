"""Batch operators: ordinals, repeats, chunks, padding, sampling, balancing and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import batch as B
from trajecta.operators import metrics as M
from trajecta.plans.base import plan, shipped, table
from trajecta.sources.tables import keep_first

PLANS: dict = {}
ORD = "select *, row_number() over (order by o_orderkey) - 1 ordinal from orders"


def orders(s, d):
    return B.with_ordinal(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@plan(PLANS, f"with o as ({ORD}) select o_orderkey, ordinal from o")
def ordinals(s, d):
    return orders(s, d).select("o_orderkey", "ordinal")


@plan(PLANS, "select o_orderkey, unnest(range(1, o_orderkey % 4 + 1)) \"copy\" from orders")
def repeat_rows(s, d):
    return B.repeat(table(s, d, "orders").select("o_orderkey"), (F.col("o_orderkey") % 4).cast("int")).select("o_orderkey", "copy")


@plan(PLANS, f"with o as ({ORD}) select ordinal // 64 chunk, count(*) n, min(o_orderkey) low, max(o_orderkey) high from o group by 1")
def chunk_rows(s, d):
    return B.chunks(orders(s, d), "ordinal", 64).groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@plan(PLANS, f"with o as ({ORD}), n as (select count(*) n from o), p as (select o_orderkey, ordinal, false is_pad from o union all select o_orderkey, n + ordinal, true from o, n where ordinal < (997 - n % 997) % 997) select is_pad, count(*) n, min(ordinal) low, max(ordinal) high, sum(o_orderkey) keys from p group by 1")
def pad_to_divisor(s, d):
    return B.pad_to(orders(s, d).select("o_orderkey", "ordinal"), "ordinal", 997).groupBy("is_pad").agg(F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.sum("o_orderkey").alias("keys"))


@plan(PLANS, f"with o as ({ORD}) select o_orderkey, ordinal from o where ordinal >= 10 and ordinal < 500 and (ordinal - 10) % 7 = 0")
def slice_rows(s, d):
    return B.select_slice(orders(s, d), "ordinal", 10, 500, 7).select("o_orderkey", "ordinal")


@plan(PLANS, f"with o as ({ORD}) select o_orderkey from o where ordinal % 5 = 2")
def modulo_shard(s, d):
    return B.shard(orders(s, d), "ordinal", 5, 2).select("o_orderkey")


@plan(PLANS, f"with o as ({ORD}) select ordinal // 8 \"row\", list(o_orderkey order by ordinal) \"values\" from o group by 1")
def fold_batch(s, d):
    return B.fold(orders(s, d), "ordinal", 8, "o_orderkey")


@plan(PLANS, "select o_orderkey, 24576 * (o_orderkey % 97 + 1) + (o_orderkey % 97 + 1) * (o_orderkey % 97 + 1) cost from orders")
def workload_cost(s, d):
    return table(s, d, "orders").select("o_orderkey", B.workload(F.col("o_orderkey") % 97 + 1).alias("cost"))


def lengths(s, d):
    return shipped(s, d, "orders").select((F.floor(F.col("o_orderkey") / 512)).alias("batch"), "o_orderkey", (F.col("o_orderkey") % 97 + 1).alias("len"))


@plan(PLANS)
def balanced_partition(s, d):
    return B.balance(lengths(s, d), "batch", "o_orderkey", "len", 4)


@plan(PLANS)
def greedy_partition(s, d):
    return B.balance(lengths(s, d), "batch", "o_orderkey", "len", 4, method="greedy")


@plan(PLANS)
def micro_batches(s, d):
    return B.micro_batches(lengths(s, d), "batch", "o_orderkey", "len", 4096)


@plan(PLANS)
def sequential_packs(s, d):
    return B.sequential_pack(lengths(s, d), "batch", "o_orderkey", "len", 16, 1024)


@plan(PLANS, "with p as (select o_orderkey // 512 batch, o_orderkey % 4 part, sum(o_orderkey % 97 + 1) s from orders group by 1, 2) select batch, cast(min(s) as bigint) part_min, cast(max(s) as bigint) part_max, round(avg(s), 4) part_mean from p group by 1")
def length_imbalance(s, d):
    x = lengths(s, d).withColumn("part", F.col("o_orderkey") % 4)
    return B.imbalance(x, "batch", "len", "part").withColumn("part_mean", F.round("part_mean", 4))


@plan(PLANS, "select o_orderkey from orders order by md5('0:' || o_orderkey), o_orderkey limit 100")
def hash_sample(s, d):
    return B.hash_sample(table(s, d, "orders"), ["o_orderkey"], 100).select("o_orderkey")


@plan(PLANS, "with w as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) * 1.0::double w from orders), r as (select o_orderkey, sum(w) over (order by o_orderkey) high, w from w), t as (select max(high) t from r), p as (select range draw, (cast('0x' || substr(md5('0:' || range), 1, 12) as bigint) + 0.5) / 281474976710656.0::double * t u from range(1000), t) select draw, o_orderkey from p join r on u >= high - w and u < high")
def weighted_draws(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return B.weighted_draws(o, "o_orderkey", "cents", 1000)


@plan(PLANS, "select o_custkey, min(o_orderkey) o_orderkey from orders group by 1")
def distinct_keep_first(s, d):
    return keep_first(table(s, d, "orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@plan(PLANS, "select c_custkey k, 'customer' kind, c_acctbal x, null::varchar status from customer union all select o_custkey, 'order', null, o_orderstatus from orders")
def union_by_name(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("x"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status"))
    return M.union_by_name(a, b)


@plan(PLANS, "select p_partkey from part except select l_partkey from lineitem where l_quantity > 45")
def set_difference(s, d):
    return table(s, d, "part").select("p_partkey").subtract(table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))


@plan(PLANS, "select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi_join(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@plan(PLANS, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def resume_anti_join(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'")
    return table(s, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@plan(PLANS, "select case when l.doc_id is null then 'missing_label' when quality = 0 then 'low_quality' when n_chars > 4000 then 'overlong' else 'kept' end reason, count(*) n from documents d left join (select doc_id, max(quality) quality from labels group by 1) l on d.doc_id = l.doc_id group by 1")
def skip_reasons(s, d):
    lab = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("seen"))
    x = table(s, d, "documents").join(lab, "doc_id", "left")
    return x.groupBy(F.when(F.col("seen").isNull(), "missing_label").when(F.col("quality") == 0, "low_quality").when(F.col("n_chars") > 4000, "overlong").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@plan(PLANS, "with b as (select o_custkey, avg(o_totalprice) m from orders where o_orderstatus = 'O' group by 1) select o_orderkey, round(coalesce(greatest(least((o_totalprice - m) / 100000, 1), 0), 0) * 0.731058578, 5) adv, m is null missing from orders left join b on b.o_custkey = orders.o_custkey where o_orderstatus <> 'O'")
def clipped_baseline_join(s, d):
    o = table(s, d, "orders")
    base = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    x = o.where("o_orderstatus <> 'O'").join(base, "o_custkey", "left")
    adv = F.coalesce(F.greatest(F.least((F.col("o_totalprice") - F.col("m")) / 100000, F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    return x.select("o_orderkey", F.round(adv * 0.731058578, 5).alias("adv"), F.col("m").isNull().alias("missing"))


@plan(PLANS, "with a as (select o_orderstatus k, count(*) n from orders group by 1), b as (select o_orderpriority k, count(*) n from orders group by 1 union all select 'F', 7) select coalesce(a.k, b.k) k, a.n old_rows, b.n new_rows, b.n - a.n delta from a full join b on a.k = b.k")
def summary_comparison(s, d):
    o = table(s, d, "orders")
    a = o.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("old_rows"))
    b = o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("new_rows")).union(s.createDataFrame([("F", 7)], "k string, new_rows long"))
    return a.join(b, "k", "full_outer").select("k", "old_rows", "new_rows", (F.col("new_rows") - F.col("old_rows")).alias("delta"))


@plan(PLANS, "with a as (select o_orderkey, row_number() over (order by o_orderkey) - 1 i from orders), b as (select o_orderkey other, row_number() over (order by o_totalprice, o_orderkey) - 1 i from orders) select i ordinal, o_orderkey, other from a join b using (i)")
def positional_zip(s, d):
    o = table(s, d, "orders")
    a = B.with_ordinal(o.select("o_orderkey"), ["o_orderkey"])
    b = B.with_ordinal(o.select("o_totalprice", F.col("o_orderkey").alias("other")), ["o_totalprice", "other"]).drop("o_totalprice")
    return B.zipped(a, b, "ordinal").select("ordinal", "o_orderkey", "other")


@plan(PLANS, "with r as (select c_custkey, row_number() over (order by c_custkey) - 1 i from customer), n as (select n_nationkey, sum(n_nationkey + 10) over (order by n_nationkey) hi, n_nationkey + 10 w from nation) select c_custkey, n_nationkey from r join n on i >= hi - w and i < hi")
def block_assignment(s, d):
    from pyspark.sql import Window

    r = B.with_ordinal(table(s, d, "customer").select("c_custkey"), ["c_custkey"])
    w = F.col("n_nationkey") + 10
    n = table(s, d, "nation").withColumn("hi", F.sum(w).over(Window.orderBy("n_nationkey"))).select("n_nationkey", (F.col("hi") - w).alias("lo"), "hi")
    return r.join(F.broadcast(n), (F.col("ordinal") >= F.col("lo")) & (F.col("ordinal") < F.col("hi"))).select("c_custkey", "n_nationkey")  # the blocks are 25 rows


@plan(PLANS, "select conv_id, cast(count(*) filter (role = 'user') as bigint) users, cast(count(*) filter (role = 'assistant') as bigint) assistants from conversations group by 1")
def role_histogram(s, d):
    from trajecta.functions.arrays import histogram

    c = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r")).withColumn("h", histogram(F.col("r")))
    return c.select("conv_id", F.coalesce(F.try_element_at("h", F.lit("user")), F.lit(0)).cast("long").alias("users"), F.coalesce(F.try_element_at("h", F.lit("assistant")), F.lit(0)).cast("long").alias("assistants"))


@plan(PLANS, "select o_orderkey % 4 server, count(*) n from (select *, o_custkey from orders) group by 1")
def round_robin(s, d):
    return table(s, d, "orders").groupBy(F.pmod("o_orderkey", F.lit(4)).alias("server")).agg(F.count("*").alias("n"))


@plan(PLANS, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def pagination(s, d):
    from trajecta.operators.catalog import page

    return page(table(s, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_totalprice")


@plan(PLANS, "select count(*) n, count(distinct o_custkey) uids, count(*) filter (o_orderstatus = 'O') raw_rows, count(*) filter (o_orderstatus <> 'O') prefix_rows, count(*) filter (o_totalprice > 150000) positive from orders")
def build_summary(s, d):
    return table(s, d, "orders").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("uids"), F.count_if(F.col("o_orderstatus") == "O").alias("raw_rows"), F.count_if(F.col("o_orderstatus") != "O").alias("prefix_rows"), F.count_if(F.col("o_totalprice") > 150000).alias("positive"))


@plan(PLANS, "select step, round(max(case when k = 'click' then v end) * 0.731058578, 5) click, round(max(case when k = 'view' then v end) * 0.731058578, 5) \"view\" from (select day(ts) step, event_type k, avg(value) v from events group by 1, 2) group by 1")
def metric_pivot(s, d):
    e = table(s, d, "events").groupBy(F.dayofmonth("ts").alias("step"), F.col("event_type").alias("k")).agg(F.avg("value").alias("v"))
    return e.groupBy("step").pivot("k", ["click", "view"]).agg(F.first("v")).select("step", F.round(F.col("click") * 0.731058578, 5).alias("click"), F.round(F.col("view") * 0.731058578, 5).alias("view"))
