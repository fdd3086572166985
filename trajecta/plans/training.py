"""Training rows over ``conversations`` and ``orders``, rewards and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajecta.functions import scoring
from trajecta.operators import messages as M
from trajecta.operators import metrics, records, rewards
from trajecta.operators import training_rows as R
from trajecta.plans.base import plan, shipped, table
from trajecta.plans.conversations import LONG, VAR, convs
from trajecta.sources import tables as T

PLANS: dict = {}
SYSTEM = "You solve the task."


def episodes(s, d):
    """Conversations with what a base row knows of them."""
    c = convs(s, d)
    return c.withColumns({"sample_uid": F.concat(F.lit("s"), F.col("conv_id").cast("string")), "item_id": F.col("conv_id").cast("string"), "sample_idx": F.lit(0), "task_id": F.col("conv_id"), "goal": F.lit(None).cast("string"), "data_source": F.lit("chat"), "ability": F.lit("talk"), "reward_model": F.struct(F.lit("").alias("ground_truth"), F.lit("interaction").alias("style")), "prompt": F.slice("messages", 1, 1)})


def all_records(s, d):
    e = episodes(s, d)
    cut = M.variants(e, "conv_id", [0.3, 0.5]).where("not is_raw").select(F.col("conv_id").alias("_c"), F.col("variant").alias("variant_label"), F.col("prefix").alias("prefix_messages"), F.col("continuation").alias("continuation_messages"), F.lit("fixed_ratio").alias("strategy"))
    return R.prefix_records(e.join(cut, e.conv_id == cut["_c"]), "main", SYSTEM).unionByName(R.raw_records(e, "main", "base-model"))


SIZES = f"""{VAR}, z as (select p.conv_id, variant, is_raw, count(*) filter (not is_raw and cutp is not null and l.i <= cutp) n_prefix, count(*) filter (not is_raw and (cutp is null or l.i > cutp)) n_rest, count(*) filter (not is_raw and (cutp is null or l.i > cutp) and l.role = 'user') u from p join l on l.conv_id = p.conv_id group by 1, 2, 3)"""


@plan(PLANS, f"{SIZES} select 'main::s' || conv_id || '::' || variant record_uid, 'main' main_dataset, variant variant_label, is_raw is_raw_variant, 's' || conv_id sample_uid, cast(conv_id as varchar) item_id, 0 sample_idx, cast(conv_id as int) task_id, case when is_raw then 'raw' else 'fixed_ratio' end strategy, 'chat' data_source, 'talk' ability, case when is_raw then 1 else 1 + n_prefix + least(u, 1) end n_prompt, n_prefix, n_rest, case when is_raw then 'raw' else 'constructed_from_sampling' end replay_category, case when is_raw then 0 end prefix_token_count, case when is_raw then 0 end span_end, case when is_raw then 'base-model' end model, 'canonicalized_prompt' coordinates, cast(conv_id as int) session_id, variant extra_label, case when is_raw or u = 0 then 'other' else 'user' end last_role from z")
def training_records(s, d):
    x = all_records(s, d)
    last = F.when(~F.col("is_raw_variant") & (F.size(F.filter("continuation_messages", lambda m: m["role"] == "user")) > 0), F.element_at("prompt", -1)["role"]).otherwise("other")
    cols = ["record_uid", "main_dataset", "variant_label", "is_raw_variant", "sample_uid", "item_id", "sample_idx", "task_id", "strategy", "data_source", "ability"]
    return x.select(*cols, F.size("prompt").cast("long").alias("n_prompt"), F.size("prefix_messages").cast("long").alias("n_prefix"), F.size("continuation_messages").cast("long").alias("n_rest"), "replay_category", "prefix_token_count", F.col("assistant_prefix_span.end").alias("span_end"), F.col("source_oldlogprob_model_path").alias("model"), F.col("prefix_coordinate_system").alias("coordinates"), F.col("extra_info.interaction_kwargs.session_id").alias("session_id"), F.col("extra_info.variant_label").alias("extra_label"), last.alias("last_role"))


@plan(PLANS, f"{SIZES} select variant variant_label, count(*) n, count(distinct conv_id) uids, cast(sum(n_prefix) as bigint) prefix_messages, (select count(*) from z) manifest_rows, true keys_unique from z group by 1")
def flagship_build(s, d):
    """Conversations to records to a table with its manifest, read back and summed up."""
    path = f"{T.shared_dir(s)}/records-{uuid.uuid4().hex}"
    m = T.write_with_manifest(all_records(s, d), path, "record_uid", "variant_label")
    x = s.read.parquet(path).groupBy("variant_label").agg(F.count("*").alias("n"), F.count_distinct("sample_uid").alias("uids"), F.sum(F.size("prefix_messages")).alias("prefix_messages"))
    return x.withColumns({"manifest_rows": F.lit(m["rows"]).cast("long"), "keys_unique": F.lit(m["rows"] == m["unique_keys"])})


@plan(PLANS, f"{SIZES} select 's' || conv_id sample_uid, variant variant_label, 'textcraft' data_source, 'crafting' ability, 1 + n_prefix + least(u, 1) n_prompt, 0 \"index\", 'fixed_ratio' strategy, 'interaction' style from z where not is_raw")
def canonical_records(s, d):
    x = R.canonical_rows(all_records(s, d).where("not is_raw_variant").drop("extra_info"), SYSTEM)
    return x.select("sample_uid", "variant_label", "data_source", "ability", F.size("prompt").cast("long").alias("n_prompt"), F.col("extra_info.index").alias("index"), F.col("extra_info.strategy").alias("strategy"), F.col("extra_info.reward_model.style").alias("style"))


@plan(PLANS, "select 'rank::s' || conv_id || '::rank' || turn record_uid, 'rank' || turn variant_label, 'chat' data_source, cast(conv_id as int) data_idx, 'entropy_stage7_audited' source_dataset from conversations")
def ranked_records(s, d):
    c = table(s, d, "conversations").select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("sample_uid"), F.col("conv_id").alias("task_id"), F.col("turn").alias("candidate_rank"), F.lit("g").alias("goal"), F.array(F.lit("look")).alias("prefix_actions"))
    base = episodes(s, d).select("task_id", "data_source", "ability", "reward_model")
    return R.ranked_rows(c, base, "rank").select("record_uid", "variant_label", "data_source", F.col("extra_info.interaction_kwargs.data_idx").alias("data_idx"), "source_dataset")


@plan(PLANS, "select o_orderkey, o_orderstatus from orders order by case when o_orderstatus = 'F' and o_orderkey % 500 = 0 then 0 else 1 end, o_orderkey limit 64")
def debug_rows(s, d):
    return R.debug_subset(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 500 == 0), ["o_orderkey"], 64)


@plan(PLANS, "select s_suppkey, coalesce(case when n_regionkey < 3 then n_name end, s_name) s_name, case when n_regionkey < 3 then n_regionkey end n_regionkey from supplier left join nation on n_nationkey = s_nationkey")
def merged_metadata(s, d):
    meta = table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"), "n_regionkey")
    return R.merge_metadata(table(s, d, "supplier"), meta, "s_nationkey", ["s_name", "n_regionkey"]).select("s_suppkey", "s_name", "n_regionkey")


@plan(PLANS, "with t as (select l_returnflag, count(*) candidates, count(*) filter (l_linestatus = 'O') usable, count(distinct l_orderkey) uids from lineitem group by 1) select x.l_returnflag, l_linestatus, x.n \"rows\", candidates, usable, uids from (select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2) x join t on t.l_returnflag = x.l_returnflag")
def replay_manifests(s, d):
    return R.replay_manifest(table(s, d, "lineitem"), "l_returnflag", "l_linestatus", "l_orderkey", ["O"])


@plan(PLANS, "with p as (select conv_id, turn, row_number() over (partition by conv_id order by turn) k from conversations) select conv_id, turn, k - 1 replay_turn, greatest(k - 1, 0) shared from p")
def replay_orders(s, d):
    whole = F.sort_array(F.collect_list(F.struct("turn", "text")))
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(whole, lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["text"])).alias("all"))
    c = c.withColumn("n", F.explode(F.sequence(F.lit(1), F.size("all")))).select("conv_id", F.slice("all", F.lit(1), F.col("n")).alias("acts"), F.element_at("all", F.col("n")).alias("text"))
    x = R.replay_order(c, "conv_id", "acts", "text")
    return x.select("conv_id", F.split(F.element_at("acts", -1), " ")[0].cast("long").alias("turn"), F.col("turn").cast("long").alias("replay_turn"), F.col("shared").cast("long").alias("shared"))


@plan(PLANS, "select o_orderkey, o_orderkey % 5 > 2 is_prefix, o_orderkey % 5 <= 2 is_raw, o_orderkey % 5 > 2 and o_orderstatus = 'F' is_terminal from orders")
def episode_flags(s, d):
    acts = F.array_repeat(F.lit("a"), F.greatest(F.col("o_orderkey") % 5 - 2, F.lit(0)).cast("int"))
    x = table(s, d, "orders")
    return x.select("o_orderkey", *[c.alias(k) for k, c in records.episode_flags(acts, F.when(F.col("o_orderstatus") == "F", "late_Terminal").otherwise("open")).items()])


@plan(PLANS, "select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_custkey end, o_orderkey + 1) reset_key from orders")
def reset_keys(s, d):
    x = table(s, d, "orders")
    return x.select("o_orderkey", records.reset_key(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")), F.col("o_orderkey") + 1).alias("reset_key"))


@plan(PLANS, "select o_orderstatus = 'F' met, count(*) n, cast(sum(o_orderkey) as bigint) keys from orders group by 1")
def mask_split(s, d):
    a, b = records.split_rows(table(s, d, "orders"), F.col("o_orderstatus") == "F")
    sums = lambda x, m: x.agg(F.lit(m).alias("met"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return sums(a, True).union(sums(b, False)).where("n > 0")


@plan(PLANS, "select p_partkey, 'x' || p_name goal, p_size task_id, p_brand name from part")
def nested_updates(s, d):
    e = F.struct(F.lit(1).alias("index"), F.struct(F.col("p_brand").alias("name"), F.col("p_name").alias("goal"), F.lit(0).alias("task_id")).alias("interaction_kwargs"))
    x = table(s, d, "part").select("p_partkey", records.with_kwargs(e, goal=F.concat(F.lit("x"), "p_name"), task_id=F.col("p_size")).alias("e"))
    return x.select("p_partkey", F.col("e.interaction_kwargs.goal").alias("goal"), F.col("e.interaction_kwargs.task_id").alias("task_id"), F.col("e.interaction_kwargs.name").alias("name"))


@plan(PLANS, "select s_suppkey, s_name, s_acctbal, s_nationkey + 1 more from supplier")
def column_union(s, d):
    x = table(s, d, "supplier")
    return records.union_columns(x.select("s_suppkey", "s_name", "s_acctbal"), x.select("s_suppkey", "s_name", (F.col("s_nationkey") + 1).alias("more")), "s_suppkey")


@plan(PLANS, "select event_type \"mode\", count(*) n from events group by 1")
def flag_totals(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("x"))
    from trajecta.functions.arrays import histogram

    x = records.flag_summary(e.withColumn("h", histogram(F.col("x"))), "h")
    return x.select("mode", F.col("n").cast("long").alias("n"))


@plan(PLANS, "with r as (select distinct o_orderstatus, o_custkey, dense_rank() over (partition by o_orderstatus order by o_custkey) k from orders), e as (select o_orderstatus, list(o_custkey order by o_custkey) examples from r where k <= 5 group by 1) select o.o_orderstatus, count(*) n, count(distinct o_custkey) uids, any_value(examples) examples from orders o join e on e.o_orderstatus = o.o_orderstatus group by 1")
def drop_reasons(s, d):
    return records.drop_summary(table(s, d, "orders"), "o_orderstatus", "o_custkey", 5)


@plan(PLANS, "select conv_id, turn from conversations where not (turn % 2 = 0 and conv_id % 3 <> 0)")
def resumed_samples(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn")
    done = c.where("turn % 2 = 0 and conv_id % 3 <> 0").withColumn("o", F.lit(1))
    return records.resume_eval(done.union(done), c, "conv_id", "turn", "o")


@plan(PLANS, "select p_partkey, case when p_partkey % 3 = 0 then 1.0 when p_partkey % 3 = 1 then 0.25 else 0.0 end score, '{}' score_info from part")
def row_rewards(s, d):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    x = shipped(s, d, "part").select("p_partkey", F.lit("qa").alias("source"), F.when(k == 0, F.concat(F.lit("so "), n)).when(k == 1, F.upper(n)).otherwise(F.lit("zzz")).alias("response"), n.alias("truth"))
    reward = rewards.load_reward(scoring.__file__, "contained_reward", loose=0.25)
    return rewards.manage(x, reward, "source", "response", "truth").select("p_partkey", "score", "score_info")


@plan(PLANS, "select o_orderkey, round(o_totalprice / 1000, 6) score, '{\"n\": ' || length(o_orderpriority) || '}' score_info from orders")
def batch_rewards(s, d):
    x = shipped(s, d, "orders").select("o_orderkey", F.lit("o").alias("source"), "o_orderpriority", F.col("o_totalprice").alias("truth"))
    reward = lambda sources, responses, truths, extras: [{"score": t / 1000, "n": len(r)} for r, t in zip(responses, truths, strict=True)]
    return rewards.manage(x, reward, "source", "o_orderpriority", "truth", by="batch").select("o_orderkey", F.round("score", 6).alias("score"), "score_info")


@plan(PLANS, "select event_type, round(quantile_cont(value, 0.5), 6) middle from events group by 1")
def reduced_by_python(s, d):
    """The reduction that a Python function would give, by the aggregate that needs no group in one task."""
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("middle"))


@plan(PLANS)
def validation_bootstrap(s, d):
    return rewards.validation_table(table(s, d, "events"), "event_type", "user_id", "value", "event_id", vote="event_id")


@plan(PLANS, "with g as (select event_type, user_id, count(*) n, avg(value) m, stddev_pop(value) sd from events group by 1, 2), l as (select event_type, 'mean@' || n metric, m v from g union all select event_type, 'std@' || n, sd from g where n > 1) select event_type, metric, round(avg(v) * 0.731058578, 4) \"value\", count(*) n_uid from l group by 1, 2")
def validation_means(s, d):
    x = rewards.validation_table(table(s, d, "events"), "event_type", "user_id", "value", "event_id", draws=1).where("metric not like '%/%'")
    return x.select("event_type", "metric", F.round(F.col("value") * 0.731058578, 4).alias("value"), "n_uid")


@plan(PLANS, "with r as (select event_type, user_id, avg(value) m from events group by 1, 2) select event_type, round(avg(m), 6) test_score, count(*) \"rows\" from r group by 1")
def eval_mean_by_source(s, d):
    return metrics.source_means(table(s, d, "events"), "event_type", "user_id", "value").withColumn("test_score", F.round("test_score", 6))


@plan(PLANS, "select round(avg(case when user_id % 3 > 0 then value end), 6) \"value\", round(avg(cast(event_id % 2 as double)), 6) success, round(avg(case when event_type = 'view' then cast(event_id % 2 as double) end), 6) success_raw_mean, round(avg(case when event_type <> 'view' then cast(event_id % 2 as double) end), 6) success_prefix_mean from events")
def episode_metric_means(s, d):
    e = table(s, d, "events").select(F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), (F.col("event_id") % 2).alias("success"), (F.col("event_type") == "view").cast("int").alias("raw"), (F.col("event_type") != "view").cast("int").alias("prefix"))
    m = metrics.episode_means(e, ["value", "success"], "success", {"raw": "raw", "prefix": "prefix"})
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@plan(PLANS, "select distinct o_orderpriority, case o_orderpriority when '1-URGENT' then 0 when '5-LOW' then 1 else 2 end place, case when regexp_matches(replace(o_orderpriority, '-', '_'), '_[0-9]+$') then 0 else 1000000000 end level_place from orders")
def category_order(s, d):
    x = table(s, d, "orders").select("o_orderpriority").distinct()
    return x.select("o_orderpriority", metrics.category_rank(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"]).alias("place"), metrics.level_rank(F.translate("o_orderpriority", "-", "_")).alias("level_place"))


@plan(PLANS, "select c_custkey k, c_acctbal bal, 0 size, null::varchar brand from customer union all select p_partkey, 0, p_size, p_brand from part")
def aligned_schemas(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return metrics.aligned(a, b).select("k", "bal", "size", "brand")


@plan(PLANS, "select o_orderkey, o_totalprice from orders")
def unique_key_scan(s, d):
    return metrics.unique_key(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@plan(PLANS, "select n_nationkey, n_name, 'v1' kind from nation")
def named_batch(s, d):
    path = f"{T.shared_dir(s)}/batches-{uuid.uuid4().hex}"
    T.save_batch(table(s, d, "nation").select("n_nationkey", "n_name"), path, "nations", {"kind": "v1"})
    x, meta = T.load_batch(s, path, "nations")
    return x.withColumn("kind", F.lit(meta["kind"]))


@plan(PLANS, "select r_regionkey k, r_name name from region union all select n_nationkey, n_name from nation")
def appended_records(s, d):
    path = f"{T.shared_dir(s)}/lines-{uuid.uuid4().hex}"
    for t, p in (("region", "r"), ("nation", "n")):
        T.append_records(table(s, d, t).select(F.col(f"{p}_{t}key").alias("k"), F.col(f"{p}_name").alias("name")), path)
    return s.read.schema("k int, name string").json(path)


@plan(PLANS, "select step, key, \"value\" from (select day(ts) step, event_type key, round(avg(value), 6) \"value\" from events group by 1, 2)")
def metric_file(s, d):
    path = f"{T.shared_dir(s)}/metrics-{uuid.uuid4().hex}"
    long = table(s, d, "events").groupBy(F.dayofmonth("ts").alias("step"), F.col("event_type").alias("key")).agg(F.round(F.avg("value"), 6).alias("value"))
    T.write_metrics(long, path)
    wide = s.read.option("header", "true").csv(path)
    names = [c for c in wide.columns if c != "step"]
    return wide.unpivot("step", names, "key", "value").where("value is not null").select(F.col("step").cast("int").alias("step"), "key", F.col("value").cast("double").alias("value"))


@plan(PLANS, "select o_orderkey, o_orderstatus, o_orderkey % 3 part from orders")
def part_sink_with_resume(s, d):
    path = f"{T.shared_dir(s)}/parts-{uuid.uuid4().hex}"
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("part"))
    T.append_missing(o.where("part = 0"), path, "o_orderkey")
    T.append_missing(o, path, "o_orderkey")  # goes on where the first one stopped
    return s.read.schema(o.schema).parquet(path)


@plan(PLANS, f"with l as ({LONG}) select conv_id, turn, role, text from l")
def generation_dump(s, d):
    path = f"{T.shared_dir(s)}/dump-{uuid.uuid4().hex}"
    T.write_generations(table(s, d, "conversations"), path, "turn")
    return s.read.schema("conv_id long, turn long, role string, text string").json(path)


@plan(PLANS, "select o_orderstatus k, count(*) n from orders group by 1")
def cached_rollouts(s, d):
    path = f"{T.shared_dir(s)}/cache-{uuid.uuid4().hex}"
    make = lambda: table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))
    records.cached(s, path, make)
    return records.cached(s, path, lambda: make().where("false"))
