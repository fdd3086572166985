"""Layouts of batches, searches in the shop and recipe predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import arrays
from trajecta.operators import batch as B
from trajecta.operators import catalog as C
from trajecta.operators import graph as G
from trajecta.operators import layout as L
from trajecta.operators import shop as SH
from trajecta.plans.base import parts_by_rows, plan, shipped, table
from trajecta.plans.batches import ORD, lengths, orders
from trajecta.plans.catalogs import BM
from trajecta.sources.tables import cut

PLANS: dict = {}


@plan(PLANS)
def balanced_reorder(s, d):
    x = lengths(s, d).groupBy("batch").agg(F.count("*").alias("n")).where("n % 4 = 0").select("batch")
    return L.reorder(lengths(s, d).join(x, "batch"), "batch", "o_orderkey", "len", 4)


PERM = "select o_orderkey, row_number() over (order by o_orderkey) - 1 i, row_number() over (order by md5(cast(o_orderkey as varchar)), o_orderkey) - 1 j from orders"


@plan(PLANS, f"select j i, i j from ({PERM})")
def inverse_permutation(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"))
    x = B.with_ordinal(B.with_ordinal(o, ["o_orderkey"], "i"), ["h", "o_orderkey"], "j")
    return L.inverse(x, "i", "j").select("i", "j")


@plan(PLANS, f"with o as ({ORD}) select ordinal, o_orderkey \"value\" from o")
def unfold_batch(s, d):
    return L.unfold(B.fold(orders(s, d), "ordinal", 8, "o_orderkey"), "row", "values", 8)


@plan(PLANS, "with q as (select l_orderkey k, list(l_linenumber order by l_linenumber, l_partkey) v from lineitem group by 1), m as (select max(len(v)) n from q) select k, list_concat(v, [-1 for i in range(0, cast(ceil(n / 4.0) * 4 as bigint) - len(v))]) v, list_concat([1 for i in range(0, len(v))], [0 for i in range(0, cast(ceil(n / 4.0) * 4 as bigint) - len(v))]) mask, v again from q, m")
def ragged_layout(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda v: v["l_linenumber"]).alias("v"))
    p = L.padded(x, "v", F.lit(-1), multiple=4)
    return p.select("k", "v", "mask", L.ragged(F.col("v"), F.col("mask")).alias("again"))


@plan(PLANS, "with e as (select o_orderkey, unnest([0, 1]) epoch from orders), r as (select *, row_number() over (partition by epoch order by md5('7:' || epoch || ':' || o_orderkey), o_orderkey) - 1 i from e) select o_orderkey, epoch, i // 64 batch, i % 64 place from r where i // 64 < (select count(*) from orders) // 64")
def shuffled_mini_batches(s, d):
    return L.mini_batches(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 64, 2, 7, drop_last=True)


@plan(PLANS, "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 100")
def longest_documents(s, d):
    return L.longest_first(table(s, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), ["doc_id"], 100)


@plan(PLANS, "select o_orderkey, sum(cast(round(o_totalprice * 100) as bigint)) over (order by o_orderkey) * 1.0 high from orders")
def cumulative_weights(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("w"))
    return L.running_weights(o, "o_orderkey", "w").select("o_orderkey", "high")


@plan(PLANS, f"with o as ({ORD}), n as (select count(*) n from o), x as (select 'dp_compute' mode_name, ordinal // (n // 5) \"rank\", o_orderkey from o, n where n % 5 = 0 union all select 'one_to_all', r, o_orderkey from o, (select unnest([0, 1, 2, 3, 4]) r) union all select 'rank_zero', 0, o_orderkey from o) select mode_name, cast(\"rank\" as int) \"rank\", count(*) n, cast(sum(o_orderkey) as bigint) keys from x group by 1, 2")
def dispatch_modes(s, d):
    o = B.with_ordinal(shipped(s, d, "orders").select("o_orderkey"), ["o_orderkey"])
    parts = parts_by_rows(o)

    def work(parts):
        for pdf in parts:
            for r, g in pdf.groupby("rank"):
                yield g.assign(rank=r)[["rank", "o_orderkey"]]

    out = None
    for name in L.MODES:
        x = L.dispatch(o, name, "ordinal", 5, work, "rank int, o_orderkey long", parts).groupBy(F.lit(name).alias("mode_name"), "rank").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        out = x if out is None else out.unionByName(x)
    return out


@plan(PLANS, "with q as (select l_orderkey k, list(l_linenumber order by l_linenumber, l_partkey) a, list(case when l_partkey % 2 = 0 then l_linenumber else 0 end order by l_linenumber, l_partkey) b, list(cast(l_returnflag <> 'R' as int) order by l_linenumber, l_partkey) m from lineitem group by 1) select k, len([1 for i in range(1, len(a) + 1) if m[i] = 1 and a[i] <> b[i]]) n_diff from q")
def token_diff_counts(s, d):
    e = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(e.alias("e"))
    a, b, m = F.transform("e", lambda v: v["l_linenumber"]), F.transform("e", lambda v: F.when(v["l_partkey"] % 2 == 0, v["l_linenumber"]).otherwise(0)), F.transform("e", lambda v: (v["l_returnflag"] != "R").cast("int"))
    return x.select("k", arrays.diff_count(a, b, m).cast("long").alias("n_diff"))


# shop


def products(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", C.token_set(F.col("p_type")).alias("attrs"), "p_brand", "p_size", F.concat_ws(" ", "p_name", "p_type").alias("text"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("query"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''))"


@plan(PLANS, f"""with a as (select p_partkey, unnest({WORDS}) a from part), q as (select p_partkey search, p_partkey // 50 % 4 kind, p_brand, p_size, {WORDS}[1] a from part where p_partkey % 50 = 0),
n as (select count(*) n from part), o as (select p_partkey, row_number() over (order by md5(cast(p_partkey as varchar)), p_partkey) - 1 i from part),
r as (select search, cast(floor((cast('0x' || substr(md5('r:' || search), 1, 12) as bigint) + 0.5) / 281474976710656.0 * n) as bigint) st, n, unnest(range(1, 51)) k from q, n where kind = 3),
x as (select search, a.p_partkey product from q join a on a.a = q.a where kind = 0 union all select search, p.p_partkey from q join part p on p.p_brand = q.p_brand where kind = 1 union all select search, p.p_partkey from q join part p on p.p_size = q.p_size where kind = 2)
select search, product, row_number() over (partition by search order by product) "rank" from x union all select search, p_partkey, k from r join o on o.i = (st + k - 1) % n where k <= n""")
def shop_searches(s, d):
    p = table(s, d, "part").where("p_partkey % 50 = 0").withColumn("kind", F.floor(F.col("p_partkey") / 50) % 4)
    k = F.col("kind")
    words = F.when(k == 0, F.concat(F.lit("<a> "), F.element_at(C.token_set(F.col("p_type")), 1))).when(k == 1, F.concat(F.lit("<c> "), F.col("p_brand"))).when(k == 2, F.concat(F.lit("<q> size "), F.col("p_size").cast("string"))).otherwise("<r>")
    return SH.routed(p.select("p_partkey", words.alias("keywords")), products(s, d), "p_partkey", "keywords", "p_partkey", "attrs", "p_brand", "query", "text").select("search", "product", F.col("rank").cast("long").alias("rank"))


@plan(PLANS, BM.replace("rank <= 10", "rank <= 50"))
def shop_text_searches(s, d):
    p = table(s, d, "part").where("p_partkey % 50 = 0")
    x = SH.routed(p.select("p_partkey", "p_name"), products(s, d), "p_partkey", "p_name", "p_partkey", "attrs", "p_brand", "query", "text").select(F.col("search").alias("query"), F.col("product").alias("p_partkey"), "rank")
    scores = C.bm25(products(s, d).select("p_partkey", "text"), p.select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text")), "p_partkey", "query", "text", 50).select("query", "p_partkey", "score")
    return x.join(scores, ["query", "p_partkey"]).select("query", "p_partkey", "score", "rank")


@plan(PLANS, "select s_suppkey, s_name, n_name, n_regionkey from supplier left join (select * from nation where n_regionkey <> 1) n on n_nationkey = s_nationkey")
def review_left_join(s, d):
    n = table(s, d, "nation").where("n_regionkey <> 1").withColumnRenamed("n_nationkey", "s_nationkey")
    return SH.with_reviews(table(s, d, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name", "n_name", "n_regionkey")


@plan(PLANS, "select p_partkey, lower(p_name || ' ' || p_type || ' ' || case when p_size % 2 = 0 then p_brand else '' end || ' ' || case when p_size % 3 = 0 then '' else 'color: red, ' || p_type || ', and size: ' || p_size end) contents from part")
def search_texts(s, d):
    o = F.create_map(F.lit("size"), F.array(F.col("p_size").cast("string")), F.lit("color"), F.array(F.lit("red"), F.col("p_type")))
    bullets = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    none = F.create_map().cast("map<string,array<string>>")
    return table(s, d, "part").select("p_partkey", SH.search_text(F.col("p_name"), F.col("p_type"), bullets, F.when(F.col("p_size") % 3 == 0, none).otherwise(o)).alias("contents"))


@plan(PLANS, "with g as (select p_partkey, p_size w from part where p_brand <> 'Brand#11'), e as (select *, -ln((cast('0x' || substr(md5('233:' || p_partkey), 1, 12) as bigint) + 0.5) / 281474976710656.0) / w e from g) select p_partkey, w from e order by e, p_partkey limit 200")
def goal_sample(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").alias("w"), "p_brand")
    return SH.select_goals(p, "p_partkey", "w", 200, F.col("p_brand") != "Brand#11").select("p_partkey", "w")


@plan(PLANS, f"with a as (select p_partkey, unnest({WORDS}[1:2]) attribute from part) select attribute, count(*) products, round(count(*) * 1.0 / (select count(*) from part), 8) share from a group by 1")
def attribute_coverage(s, d):
    return SH.attribute_coverage(products(s, d), "p_partkey", "attrs", 2).withColumn("share", F.round("share", 8))


@plan(PLANS, f"with a as (select p_brand, unnest({WORDS}) a from part) select p_brand, count(distinct a) n_attributes from a group by 1")
def unique_attribute_counts(s, d):
    return SH.unique_attributes(products(s, d), "p_brand", "attrs")


LCS = "case when d = o then length(d) when length(d) = 1 or length(o) = 1 then cast(contains(d, o) or contains(o, d) as int) else cast(substr(d, 1, 1) = substr(o, 1, 1) or substr(d, 2, 1) = substr(o, 2, 1) or substr(d, 1, 1) = substr(o, 2, 1) or substr(d, 2, 1) = substr(o, 1, 1) as int) end"


@plan(PLANS, f"with x as (select p_partkey, substr(p_brand, 7) d, cast(p_partkey % 25 + 1 as varchar) o from part), l as (select *, {LCS} n from x), r as (select p_partkey, case when d = o then 100.0 else round(greatest(1000.0 / (11 + length(d)), 1000.0 / (11 + length(o)), 200.0 * (6 + n) / (12 + length(d) + length(o)))) end ratio from l) select p_partkey, ratio, ratio > 85 found from r")
def fuzzy_attribute_match(s, d):
    """Brands (a word and a number) against another brand."""
    x = B.spread(table(s, d, "part"), "p_partkey").withColumn("other", F.concat(F.lit("brand "), (F.col("p_partkey") % 25 + 1).cast("string")))
    hit = C.attribute_hits(F.array("other"), F.array("p_brand"), F.lit("")) == 1
    return x.select("p_partkey", C.token_set_ratio(F.col("p_brand"), F.col("other")).alias("ratio"), hit.alias("found"))


# recipes: an order's lines are its inputs, its customer is its output, and a part's brand is its tag


def order_recipes(s, d):
    recipes = table(s, d, "orders").select(F.col("o_orderkey").alias("recipe"), F.col("o_custkey").alias("output"))
    inputs = table(s, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("item")).distinct()
    return recipes, inputs


@plan(PLANS, "select c_custkey item from customer where c_custkey in (select o_custkey from orders)")
def craftable_items(s, d):
    return G.craftable(table(s, d, "customer").select(F.col("c_custkey").alias("item")), order_recipes(s, d)[0])


@plan(PLANS, "select p_partkey item from part where p_partkey in (select o_custkey from orders union select l_partkey from lineitem where l_orderkey is not null)")
def valid_item_names(s, d):
    return G.valid_items(table(s, d, "part").select(F.col("p_partkey").alias("item")), *order_recipes(s, d))


@plan(PLANS, "select o_custkey item, o_orderkey recipe from orders join (select l_orderkey from lineitem group by 1 having count(distinct l_partkey) >= 5) on l_orderkey = o_orderkey")
def recipes_by_inputs(s, d):
    return G.with_min_inputs(*order_recipes(s, d), 5)


LAYERS = """with e as (select 'c' || c_custkey item, 'n' || c_nationkey part from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'o' || o_orderkey, 'c' || o_custkey from orders union all select 'o' || o_orderkey, 'r0' from orders where o_orderkey % 2 = 0)"""


@plan(PLANS, LAYERS + ", x as (select distinct item from e union select part from e) select item, case left(item, 1) when 'r' then 0 when 'n' then 1 when 'c' then 2 else 3 end depth from x")
def recipe_depths(s, d):
    """Places made of places: orders of a customer (and, half of them, a region), customers of a nation, nations of a region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o = table(s, d, "orders")
    e = table(s, d, "customer").select(name("c", "c_custkey").alias("recipe"), name("n", "c_nationkey").alias("item")).union(table(s, d, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(o.select(name("o", "o_orderkey"), name("c", "o_custkey"))).union(o.where("o_orderkey % 2 = 0").select(name("o", "o_orderkey"), F.lit("r0")))
    return G.min_depth(e.select("recipe", F.col("recipe").alias("output")).distinct(), e).select("item", F.col("depth"))


@plan(PLANS, "with i as (select l_orderkey recipe, l_partkey item, cast(sum(cast(l_quantity as bigint)) as bigint) n from lineitem group by 1, 2), t as (select recipe, count(*) k, count(distinct p_brand) b, min(n) lo, bool_and(p_brand is not null) ok from i join part on p_partkey = item group by 1) select recipe, 'by_tag' offer, k = b valid from t union all select recipe, 'more', false from t union all select recipe, 'other_tag', false from t")
def ingredient_match_tags(s, d):
    """Inputs asked for by brand: offers of the parts themselves fit where no brand is asked for twice; one part more, or a wrong brand, never does."""
    i = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("p")).agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    p = table(s, d, "part").select(F.col("p_partkey").alias("p"), "p_brand")
    own = cut(i.join(p, "p"))
    inputs = own.select("recipe", F.col("p_brand").alias("item"), F.lit(True).alias("is_tag"), "count")
    offer = own.select("recipe", F.col("p").cast("string").alias("item"), "count")
    tags = p.select(F.col("p").cast("string").alias("item"), F.col("p_brand").alias("tag"))
    more = offer.select("recipe", F.lit("extra").alias("item"), F.lit(1).cast("long").alias("count")).distinct()
    offers = offer.withColumn("offer", F.lit("by_tag")).unionByName(offer.unionByName(more).withColumn("offer", F.lit("more"))).unionByName(offer.withColumns({"offer": F.lit("other_tag"), "item": F.lit("stone")}))
    return G.matches(offers, inputs, tags, parts_by_rows(table(s, d, "lineitem"))).select("recipe", "offer", "valid")
