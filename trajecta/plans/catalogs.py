"""Catalogue, search, graph and session operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajecta.operators import catalog as C
from trajecta.operators import fulltext as FT
from trajecta.operators import graph as G
from trajecta.operators import stateful as S
from trajecta.operators.batch import spread
from trajecta.plans.base import parts_by_rows, plan, shipped, table
from trajecta.sources.tables import shared_dir

PLANS: dict = {}

BM = r"""with w as (select p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '')) term from part), post as (select p_partkey, term, count(*) tf from w group by 1, 2),
size as (select p_partkey, sum(tf) len from post group by 1), st as (select count(*) n, avg(len) al from size), df as (select term, count(*) df from post group by 1),
q as (select distinct p_partkey query, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) term from part where p_partkey % 50 = 0),
s as (select query, post.p_partkey, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len / al))), 6) score from post join q on q.term = post.term join df on df.term = post.term join size on size.p_partkey = post.p_partkey, st group by 1, 2)
select * from (select query, p_partkey, score, row_number() over (partition by query order by score desc, p_partkey) rank from s) where rank <= 10"""


@plan(PLANS, BM)
def bm25_top(s, d):
    p = table(s, d, "part")
    docs = p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text"))
    return C.bm25(docs, q, "p_partkey", "query", "text", 10).select("query", "p_partkey", "score", "rank")


@plan(PLANS, BM)
def indexed_search(s, d):
    """The same searches on an index that is written first and then read by impact."""
    path = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    p = table(s, d, "part")
    FT.write_index(p.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "p_partkey", "text", path)
    q = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text"))
    return FT.Index(s, path).search(q, "query", "text", 10).select("query", F.col("doc").alias("p_partkey"), "score", "rank")


@plan(PLANS, r"""with w as (select p_brand, p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') w from part), g as (select p_brand, p_partkey, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) gram from w),
tf as (select p_brand, p_partkey, gram, count(*) tf from g group by 1, 2, 3), c as (select p_brand, gram, sum(tf) total, count(*) df from tf group by 1, 2), n as (select p_brand, count(distinct p_partkey) n from part group by 1),
k as (select c.p_brand, gram, df, cast(total as bigint) total, round(total * (ln((1 + n) / (1 + df)) + 1), 6) weight from c join n on n.p_brand = c.p_brand) select * from (select *, row_number() over (partition by p_brand order by weight desc, gram) rank from k) where rank <= 5""")
def tfidf_top(s, d):
    return C.tfidf(table(s, d, "part"), "p_brand", "p_partkey", "p_name", 5)


@plan(PLANS, "select p_partkey, case when p_size % 3 = 0 then [[]::varchar[]] when p_size % 3 = 1 then [['size: ' || p_size], ['size: ' || p_brand]] else [['color: ' || p_type, 'size: ' || p_size], ['color: ' || p_type, 'size: ' || p_brand], ['color: blue', 'size: ' || p_size], ['color: blue', 'size: ' || p_brand]] end combos from part")
def option_products(s, d):
    size = F.array(F.col("p_size").cast("string"), F.col("p_brand"))
    k = F.col("p_size") % 3
    o = F.when(k == 0, F.create_map().cast("map<string,array<string>>")).when(k == 1, F.create_map(F.lit("size"), size)).otherwise(F.create_map(F.lit("size"), size, F.lit("color"), F.array(F.col("p_type"), F.lit("blue"))))
    return table(s, d, "part").select("p_partkey", C.option_combinations(o).alias("combos"))


@plan(PLANS, r"with e as (select p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''))) a from part), f as (select a, count(*) c from e group by 1) select p_partkey, round(avg(1.0 / c), 8) weight from e join f using (a) group by 1")
def attribute_weights(s, d):
    p = table(s, d, "part").withColumn("attrs", C.token_set(F.col("p_name")))
    return C.attribute_weights(p, "p_partkey", "attrs").withColumn("weight", F.round("weight", 8))


@plan(PLANS, "with x as (select p_partkey, cast(contains(lower(p_type), 'steel') as int) + cast(contains(lower(p_name), 'red') as int) hits, cast(p_size % 2 = 0 as int) opt, cast(p_retailprice <= 1000 as int) price, case p_partkey % 4 when 0 then 0.5 when 1 then 0.15 when 2 then 0.05 else 0.0 end title, p_size % 5 = 0 cat from part) select p_partkey, round((hits + opt + price) / 4.0 * case when title = 0 then 0 when title < 0.1 then 0.1 when cat or title > 0.2 then 1 else 0.5 end, 6) reward from x")
def total_reward(s, d):
    k = F.col("p_partkey") % 4
    title = F.when(k == 0, 0.5).when(k == 1, 0.15).when(k == 2, 0.05).otherwise(0.0)
    cat = C.category_match(F.lit("a › b › c"), F.when(F.col("p_size") % 5 == 0, F.lit("c › x › a")).otherwise(F.lit("a › x")))
    text = F.concat_ws(" ", "p_type", "p_name")
    hits = F.contains(F.lower("p_type"), F.lit("steel")).cast("int") + F.contains(F.lower("p_name"), F.lit("red")).cast("int")
    opt = C.option_hits(F.array(F.lit("powder snow")), F.array(F.when(F.col("p_size") % 2 == 0, F.lit("cool powder snow")).otherwise(F.lit("granite"))), [])
    r = C.total_reward(hits, opt, F.col("p_retailprice") <= 1000, F.lit(2), F.lit(1), C.type_reward(F.lit(False), cat, title))
    return spread(table(s, d, "part"), "p_partkey").withColumn("text", text).select("p_partkey", F.round(r, 6).alias("reward"))


#: Places as a graph: region to nation to customer to order.
EDGES = "select 'r' || n_regionkey s, 'n' || n_nationkey d from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders"


def edges(s, d):
    x = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    return table(s, d, "nation").select(x("r", "n_regionkey").alias("s"), x("n", "n_nationkey").alias("d")).union(table(s, d, "customer").select(x("n", "c_nationkey"), x("c", "c_custkey"))).union(table(s, d, "orders").select(x("c", "o_custkey"), x("o", "o_orderkey")))


@plan(PLANS, f"with recursive e as ({EDGES}), t as (select 'r' || r_regionkey origin, 'r' || r_regionkey node, 0 hops from region union all select origin, d, hops + 1 from t join e on e.s = t.node) select origin, hops, count(distinct node) n from t group by 1, 2")
def dependency_closure(s, d):
    start = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.closure(edges(s, d), "s", "d", start, "node").groupBy("origin", "hops").agg(F.count("*").alias("n"))


@plan(PLANS, "select l_partkey item, count(distinct l_orderkey) n_recipes from lineitem group by 1")
def uses_index(s, d):
    i = table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("recipe"))
    return G.uses(i).select("item", F.size("recipes").cast("long").alias("n_recipes"))


@plan(PLANS, "select l_orderkey recipe, 'exact' offer, true valid from lineitem group by 1 union all select l_orderkey, 'less', false from lineitem group by 1")
def ingredient_match(s, d):
    i = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    exact = i.withColumn("offer", F.lit("exact"))
    less = i.withColumns({"offer": F.lit("less"), "count": F.col("count") - 1})
    return G.matches(exact.unionByName(less), i, parts=parts_by_rows(table(s, d, "lineitem"))).select("recipe", "offer", "valid")


RECIPES = {"stick": [(4, {"planks": 2})], "planks": [(4, {"log": 1})]}


@plan(PLANS)
def crafting_sessions(s, d):
    e = shipped(s, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "view", "get 1 log").when(F.col("event_type") == "click", "craft 4 planks using 1 log").when(F.col("event_type") == "purchase", "craft 4 stick using 2 planks").otherwise("inventory").alias("action"), F.lit("stick").alias("goal"))
    return S.run_sessions(e, RECIPES)


@plan(PLANS, "select kind, count(*) n from (select case event_type when 'view' then 'got' when 'click' then 'crafted' when 'purchase' then 'not_executed' else 'other' end kind from events) group by 1")
def observation_counts(s, d):
    t = F.when(F.col("event_type") == "view", "Got 1 log").when(F.col("event_type") == "click", "Crafted 4 planks").when(F.col("event_type") == "purchase", "Could not execute x").otherwise("hm")
    return table(s, d, "events").select(S.observation_kind(t).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@plan(PLANS, "select event_id, case event_id % 5 when 0 then 'error' when 1 then 'unverifiable' when 2 then 'mismatch' when 3 then 'validated_parser_feedback' else 'validated' end verdict from events")
def replay_verdicts(s, d):
    k = F.col("event_id") % 5
    none = F.lit(None).cast("string")
    return table(s, d, "events").select("event_id", S.replay_category(F.when(k == 0, "timeout").otherwise(none), F.when(k == 1, none).otherwise(F.lit("a  b")), F.when(k == 2, "c").otherwise("a b"), k == 3).alias("verdict"))


@plan(PLANS, "select o_orderkey, case when o_orderkey % 3 = 0 then ['got', 'inventory'] else ['got'] end same, case when o_orderkey % 3 = 0 then [] else ['inventory'] end differs, case when o_orderkey % 2 = 0 then o_orderstatus || ' ' || o_orderpriority end crafted from orders")
def observation_fields(s, d):
    k = F.col("o_orderkey")
    a = S.observation_fields(F.concat(F.lit("Inventory:  [log] ("), k.cast("string"), F.lit(")\nGot 1 log\nrest"), F.when(k % 2 == 0, F.concat(F.lit("\nCrafted "), "o_orderstatus", F.lit(" "), "o_orderpriority")).otherwise("")))
    b = S.observation_fields(F.concat(F.lit("Got 1 log\nInventory: [log] ("), (k + k % 3).cast("string"), F.lit(")")))
    same, differs = S.shared_fields(a, b)
    return table(s, d, "orders").select("o_orderkey", same.alias("same"), differs.alias("differs"), F.try_element_at(a, F.lit("crafted")).alias("crafted"))
