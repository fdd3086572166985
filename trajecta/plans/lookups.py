"""Shards, documents, folders of files, reports, strict lookups and sets over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import graph as G
from trajecta.operators import messages as M
from trajecta.operators import records as R
from trajecta.plans.base import plan, table
from trajecta.sources import tables as T

PLANS: dict = {}


def _place(s, name):
    return f"{T.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


@plan(PLANS, "select o_orderkey, o_totalprice, 'v1' version from orders")
def sharded_scan(s, d):
    """Orders in three shards of one version, of which the last repeats rows of the first with a later price."""
    o, at = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.lit("v1").alias("version")), _place(s, "shards")
    for i, rows in enumerate((o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))):
        rows.write.parquet(f"{at}/shard-{i}")
    return T.read_shards(s, f"{at}/shard-*", "o_orderkey", "version", ["o_totalprice"])


@plan(PLANS, "select n_nationkey k, n_name as name, 'array' form from nation union all select n_nationkey, n_name, 'map' from nation")
def json_documents(s, d):
    """Nations as one JSON array and as one JSON object by key, read back."""
    n, at = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), _place(s, "documents")
    n.agg(F.to_json(F.collect_list(F.struct("k", "name"))).alias("value")).coalesce(1).write.text(f"{at}/array")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), F.struct("name"))))).alias("value")).coalesce(1).write.text(f"{at}/map")
    a = T.read_json_document(s, f"{at}/array", "k long, name string").select("k", "name", F.lit("array").alias("form"))
    return a.union(T.read_json_map(s, f"{at}/map", "struct<name:string>").select(F.col("key").cast("long"), "value.name", F.lit("map")))


@plan(PLANS, "select 'item_' || n_nationkey as output, n_nationkey % 3 + 1 as count, case when i = 1 then 'planks' else 'tag_' || n_regionkey end as name, i = 2 is_tag, case when n_nationkey % 2 = 0 then case when i = 1 then 3 else 1 end else i end as n from nation, (select unnest([1, 2]) i) order by 1")
def recipe_files(s, d):
    """A folder of recipe files, one for each nation: shaped ones for even keys, shapeless ones for odd keys."""
    k, at = F.col("n_nationkey"), _place(s, "recipes")
    item, tag = '{"item": "planks"}', F.concat(F.lit('[{"tag": "tag_'), "n_regionkey", F.lit('"}]'))
    result = F.concat(F.lit('"result": {"item": "item_'), k, F.lit('", "count": '), k % 3 + 1, F.lit("}"))
    shaped = F.concat(F.lit('{"type": "x:crafting_shaped", "pattern": ["##", "# ", "T"], "key": {"#": ' + item + ', "T": '), tag, F.lit("}, "), result, F.lit("}"))
    loose = F.concat(F.lit('{"type": "x:crafting_shapeless", "ingredients": [' + item + ", "), tag, F.lit(", "), tag, F.lit("], "), result, F.lit("}"))
    files = table(s, d, "nation").select(F.when(k % 2 == 0, shaped).otherwise(loose).alias("value"), k.alias("file"))
    files.write.partitionBy("file").text(at)
    out, inputs = R.read_recipes(s, at)
    return out.join(inputs.withColumnRenamed("count", "n"), "recipe").select("output", "count", "name", "is_tag", F.col("n").cast("int").alias("n"))


@plan(PLANS, "with x as (select o_orderstatus, count(*) n from orders group by 1), l as (select 4 + row_number() over (order by o_orderstatus) i, '| ' || o_orderstatus || ' | ' || n || ' |' line from x) select 1 as at, '# Orders' line union all select 2, '' union all select 3, '| o_orderstatus | n |' union all select 4, '|---|---|' union all select i, line from l")
def orders_report(s, d):
    """Orders by status as a Markdown report, line by line."""
    text = T.report(table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus"), "Orders")
    return s.createDataFrame([(i, line) for i, line in enumerate(text.rstrip("\n").split("\n"), 1)], "at int, line string")


@plan(PLANS, "select l_orderkey recipe, l_returnflag as name, l_returnflag in ('A', 'R') is_tag, count(*) as count from lineitem group by 1, 2")
def rewritten_tags(s, d):
    """Return flags as tags of which two have a craftable member; the others become items."""
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("count")).withColumn("is_tag", F.lit(True))
    modes = table(s, d, "lineitem").select(F.col("l_returnflag").alias("tag")).distinct()
    members = modes.select(F.concat(F.lit("m "), "tag").alias("item"), "tag")
    craftable = members.where(F.col("tag").isin("A", "R")).select("item")
    return G.rewrite_tags(x.select("recipe", "name", "is_tag", "count"), members, craftable)


@plan(PLANS, "select c_custkey, coalesce(n, 0) n, coalesce(first, '') first from customer left join (select conv_id, count(*) n, arg_min(text, turn) first from conversations group by 1) on conv_id = c_custkey")
def normalised_messages(s, d):
    """The messages of every customer, none where there is no conversation."""
    c = table(s, d, "customer").join(M.gather(table(s, d, "conversations")), F.col("c_custkey") == F.col("conv_id"), "left")
    m = M.normalize(F.col("messages"))
    return c.select("c_custkey", F.size(m).cast("long").alias("n"), F.coalesce(F.try_element_at(m, F.lit(1))["content"], F.lit("")).alias("first"))


@plan(PLANS, "with own as (select distinct n_regionkey goal, c_custkey % 1000 recipe from nation join customer on c_nationkey = n_nationkey), near as (select distinct n_regionkey goal, 500 + s_suppkey recipe from nation join supplier on s_nationkey = n_nationkey), e as (select goal, recipe from near except select goal, recipe from own) select goal, false distractor, count(*) n from own group by 1 union all select goal, true, least(count(*), 10) from e group by 1")
def goal_recipes(s, d):
    """Recipes of each region's closure, with ten distractors at most."""
    n = table(s, d, "nation").select(F.col("n_regionkey").alias("goal"), F.col("n_nationkey").alias("item"))
    closure = n.join(table(s, d, "customer"), F.col("item") == F.col("c_nationkey")).select("goal", "item", (F.col("c_custkey") % 1000).alias("recipe"))
    uses = table(s, d, "supplier").select(F.col("s_nationkey").alias("item"), (F.col("s_suppkey") + 500).alias("recipe"))
    return R.recipe_set(closure, uses, per_item=1_000_000).groupBy("goal", "distractor").agg(F.count("*").alias("n"))


@plan(PLANS, "select o_orderkey, c_name from orders join customer on c_custkey = o_custkey")
def strict_lookup(s, d):
    """The name of each order's customer; an order without one would raise."""
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return R.require_match(table(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left"), "c_custkey", "order of an unknown customer").select("o_orderkey", "c_name")


@plan(PLANS, "select 'same' as pair, true as valid union all select 'fewer', false union all select 'other version', false")
def cache_checks(s, d):
    """Orders as a cache of themselves: whole, with rows missing, and of another version."""
    o = table(s, d, "orders").select("o_orderkey", F.lit("v1").alias("version"))
    pairs = [("same", o), ("fewer", o.where("o_orderkey % 7 <> 1")), ("other version", o.withColumn("version", F.lit("v2")))]
    return s.createDataFrame([(n, R.cache_valid(x, o, "o_orderkey", "version")) for n, x in pairs], "pair string, valid boolean")


@plan(PLANS, "select conv_id, turn, (conv_id + turn) % 4 < 2 warmup from conversations")
def warmup_messages(s, d):
    """Messages with either warm-up form put in."""
    k = (F.col("conv_id") + F.col("turn")) % 4
    said = F.when(k == 0, F.concat("text", F.lit(" " + X.WARMUP_USER))).when(k == 1, F.concat(F.lit(X.WARMUP_USER_START), "text")).otherwise(F.concat(F.lit("x"), "text"))
    return table(s, d, "conversations").select("conv_id", "turn", X.is_warmup_user(said).alias("warmup"))


@plan(PLANS, "select o_orderkey, 'main' as dataset, 'item_' || o_orderkey || case when o_orderkey % 2 = 0 then '::7' else '' end sample, 'rank' || o_orderkey % 5 as variant from orders")
def parsed_uids(s, d):
    """Record keys built and taken apart again."""
    k = F.col("o_orderkey")
    uid = M.record_uid("main", F.concat(F.lit("item_"), k, F.when(k % 2 == 0, "::7").otherwise("")), F.concat(F.lit("rank"), k % 5))
    return table(s, d, "orders").select("o_orderkey", M.parse_uid(uid).alias("u")).select("o_orderkey", "u.dataset", "u.sample", "u.variant")
