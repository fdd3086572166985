"""Scans and sinks over the tables."""

from __future__ import annotations

import uuid
from pyspark.sql import functions as F

from trajecta.operators.candidates import within_tokens
from trajecta.plans.base import plan, shipped, table
from trajecta.sources import tables as T

PLANS: dict = {}


@plan(PLANS, "select o_orderkey, o_totalprice from orders where o_totalprice > 300000")
def projected_scan(s, d):
    return T.read_parquet(s, f"{d}/orders.parquet", columns=["o_orderkey", "o_totalprice"]).where("o_totalprice > 300000")


@plan(PLANS, "select s_suppkey k, s_name name, s_acctbal bal from supplier union all select c_custkey, c_name, c_acctbal from customer")
def multi_table_scan(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")))


@plan(PLANS, "select event_id, cast(json_extract_string(props, '$.' || json_keys(props)[1]) as varchar) first_prop from events")
def json_column_scan(s, d):
    return table(s, d, "events").select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_prop"))


@plan(PLANS, "select item_id, length(text) n_chars from benchmark")
def jsonl_round_trip(s, d):
    path = f"{T.shared_dir(s)}/jsonl-{uuid.uuid4().hex}"
    table(s, d, "benchmark").write.mode("overwrite").json(path)
    good, _ = T.read_jsonl(s, path, "item_id bigint, text string")
    return good.select("item_id", F.length("text").cast("long").alias("n_chars"))


@plan(PLANS, "select n_nationkey, n_name from nation")
def csv_round_trip(s, d):
    path = f"{T.shared_dir(s)}/csv-{uuid.uuid4().hex}"
    table(s, d, "nation").write.mode("overwrite").option("header", "true").csv(path)
    return T.read_csv(s, path, "n_nationkey int, n_name string, n_regionkey int", ["n_name"], ["n_nationkey"]).select("n_nationkey", "n_name")


@plan(PLANS, "select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then o_custkey end, case when o_orderkey % 3 = 1 then o_orderkey end, -1) task_id from orders")
def fallback_keys(s, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("task_"), F.col("o_custkey").cast("string"))).otherwise(F.lit("none"))
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.regexp_extract(raw, r"_(\d+)$", 1).try_cast("bigint"), F.when(k % 3 == 1, k), F.lit(-1)).alias("task_id"))


@plan(PLANS, "select c_custkey, case when c_custkey % 40 + 1 <= 20 then 'goto' when c_custkey % 40 + 1 <= 30 then 'pickup' else 'other' end family from customer")
def task_categories(s, d):
    level = F.pmod("c_custkey", F.lit(40)) + 1
    return table(s, d, "customer").select("c_custkey", F.when(level <= 20, "goto").when(level <= 30, "pickup").otherwise("other").alias("family"))


@plan(PLANS, "select p_partkey, p_name renamed from part where p_size >= 10 and p_brand is not null")
def select_rename_filter(s, d):
    return table(s, d, "part").where("p_size >= 10 and p_brand is not null").withColumnsRenamed({"p_name": "renamed"}).drop("p_type", "p_size", "p_retailprice", "p_brand")


@plan(PLANS, "select doc_id from documents where length(text) / 4.0 <= 300")
def overlong_filter(s, d):
    return table(s, d, "documents").where(F.length("text") / 4 <= 300).select("doc_id")


@plan(PLANS)
def prompts_within_tokens(s, d):
    """First messages of all conversations that a tokenizer file gives 120 tokens at most (a test counts them again)."""
    import public_tokenizers

    x = shipped(s, d, "conversations").where("turn = 0")
    return within_tokens(x, F.col("text"), public_tokenizers.path("byte_bpe_50k.json"), 120).select("conv_id", "text")
