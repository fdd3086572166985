"""Recipe graphs: closures, depths, craftability and the inventory reducer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.sources.tables import cut, discard


def closure(edges: DataFrame, src: str, dst: str, start: DataFrame, node: str, rounds: int = 64) -> DataFrame:
    """(origin, node, hops) reachable from each start; a node is visited once, so cycles end."""
    e = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    seen = cut(start.select(F.col(node).alias("origin"), F.col(node).alias("node"), F.lit(0).alias("hops")).distinct())
    front = seen
    for k in range(1, rounds + 1):
        new = front.join(e, front.node == e.s).select("origin", F.col("d").alias("node"), F.lit(k).alias("hops")).distinct()
        front = cut(new.join(seen, ["origin", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError("the graph is deeper than the rounds allowed")


def min_depth(recipes: DataFrame, inputs: DataFrame, rounds: int = 64) -> DataFrame:
    """Least depth of every item: 0 for items without a recipe, else over its recipes the least of one more than the deepest input.

    recipes (recipe, output), inputs (recipe, item).  Depth by depth: inputs of
    the depth just reached are struck off, and recipes with none left give their
    outputs the next one, so an input is met once.  Items whose every recipe
    needs a cycle get no row.
    """
    made = cut(recipes.select("recipe", F.col("output").alias("item")).distinct())
    rest = cut(inputs.where("recipe is not null and item is not null").select("recipe", "item").distinct())
    front = cut(inputs.select("item").union(made.select("item")).distinct().join(made.select("item"), "item", "left_anti").withColumn("depth", F.lit(0)))
    depth = front
    for k in range(1, rounds + 1):
        hit = rest.join(front, "item", "left_semi").select("recipe").distinct()
        left = cut(rest.join(front, "item", "left_anti"))
        items = hit.join(left, "recipe", "left_anti").join(made, "recipe").select("item").distinct()
        old = depth.select(F.col("item").alias("_old"))
        front = cut(items.join(old, items["item"].eqNullSafe(old["_old"]), "left_anti").withColumn("depth", F.lit(k)))
        discard(rest)
        if front.isEmpty():
            discard(left)
            return depth
        rest, depth = left, depth.unionByName(front)
    raise RuntimeError("depths did not settle")


def uses(inputs: DataFrame) -> DataFrame:
    """Recipes that use each item."""
    return inputs.groupBy("item").agg(F.sort_array(F.collect_set("recipe")).alias("recipes"))


def rewrite_tags(inputs: DataFrame, members: DataFrame, craftable: DataFrame) -> DataFrame:
    """Tag inputs without a craftable member become items of the same name: (recipe, name, is_tag, count)."""
    good = members.join(craftable, "item", "left_semi").select(F.col("tag").alias("_t")).distinct()
    j = inputs.join(good, inputs.name == good["_t"], "left")
    return j.select("recipe", "name", (F.col("is_tag") & F.col("_t").isNotNull()).alias("is_tag"), "count")


def matches(offers: DataFrame, inputs: DataFrame, tags: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Offers (offer, recipe, item, count) that meet their recipe exactly: same items, same counts, nothing left over.

    With ``tags`` (item, tag) an input of ``inputs`` whose is_tag is true is met
    by the tag itself or by any item that has it.  Offers and inputs of a recipe
    go to one of ``parts`` partitions, are sorted by name there and meet by
    windows over a name, so no offered item is held against every input.
    """
    parts = parts or int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count, asked = F.col("count").cast("long").alias("count"), F.col("_asked")
    wanted = inputs.select("recipe", "item", count, *(["is_tag"] if tags is not None else []), F.lit(True).alias("_asked"))
    of_name, of_recipe = Window.partitionBy("recipe", "item"), Window.partitionBy("recipe")
    known = F.col("offer").isNotNull() & F.col("recipe").isNotNull()
    if tags is None:
        rows = offers.select("offer", "recipe", "item", count, F.lit(False).alias("_asked")).unionByName(wanted, allowMissingColumns=True)
        g = rows.repartition(parts, "recipe").groupBy("_asked", "offer", "recipe", "item").agg(F.sum("count").alias("given"), F.min("count").alias("_lo"), F.max("count").alias("_hi"), (F.count("*") > F.count("count")).alias("_open"))
        ask = lambda c: F.max(F.when(asked, F.col(c))).over(of_name)
        x = g.select("_asked", "offer", "recipe", "item", "given", ask("_lo").alias("_lo"), ask("_hi").alias("_hi"), ask("_open").alias("_open"), F.coalesce(F.sum(F.when(asked & F.col("_hi").isNotNull(), 1)).over(of_recipe), F.lit(0)).alias("_need"))
        # a null count is met by none or a null one
        met = known & F.col("item").isNotNull() & F.col("_open").isNotNull()
        fits = F.when(met, F.col("_lo").eqNullSafe(F.col("given")) & F.col("_hi").eqNullSafe(F.col("given")) & (F.col("given").isNull() | ~F.col("_open"))).otherwise(F.col("given").isNull())
        x = x.where(~asked).groupBy("offer", "recipe").agg(F.bool_and(fits).alias("_fits"), F.count(F.when(met & F.col("_hi").isNotNull(), 1)).alias("_met"), F.max(F.when(F.col("recipe").isNotNull(), F.col("_need")).otherwise(0)).alias("_need"))
        return x.select("offer", "recipe", (F.col("_fits") & (F.col("_met") == F.col("_need"))).alias("valid"))
    o = offers.select("offer", "recipe", "item", count).repartition(parts, "offer", "recipe").groupBy("offer", "recipe", "item").agg(F.sum("count").alias("count"))
    sizes = cut(o.groupBy("offer", "recipe").agg(F.count("item").alias("_have")).join(inputs.groupBy("recipe").agg(F.count("*").alias("_need")), "recipe", "left"))
    # only offers of as many items as are asked for can fit, and the names of no others are looked at
    o = o.join(sizes.where("_have = _need").select("offer", "recipe").hint("shuffle_hash"), ["offer", "recipe"], "left_semi")
    # every tag stands eight times, so one item of very many offers is dealt over eight places
    deal = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_deal")
    t = tags.groupBy("item").agg(F.collect_set("tag").alias("_tags")).select("item", "_tags", deal).hint("shuffle_hash")
    o = o.withColumn("_deal", F.pmod(F.xxhash64("recipe"), F.lit(8)).cast("int")).join(t, ["item", "_deal"], "left").drop("_deal").withColumn("_asked", F.lit(False))
    own = F.array(F.struct(F.col("item").alias("item"), F.lit(False).alias("_by_tag")))
    names = F.when(F.col("_tags").isNull(), own).otherwise(F.concat(own, F.transform("_tags", lambda v: F.struct(v.alias("item"), F.lit(True).alias("_by_tag")))))
    x = o.unionByName(wanted, allowMissingColumns=True).repartition(parts, "recipe").withColumns({"_item": F.col("item"), "_name": F.explode(names)}).withColumns({"item": F.col("_name.item"), "_by_tag": F.col("_name._by_tag")})
    want = lambda c: F.coalesce(F.col("count") == F.max(F.when(asked & c, F.col("count"))).over(of_name), F.lit(False)) & F.col("item").isNotNull()
    x = x.select("_asked", "offer", "recipe", "_item", "item", "_by_tag", want(F.col("is_tag")).alias("_tag"), (want(~F.col("is_tag")) & ~F.col("_by_tag")).alias("_own")).where(~asked & (F.col("_tag") | F.col("_own")))
    x = x.groupBy("offer", "recipe").agg((F.count_distinct(F.when(F.col("_tag"), F.col("item"))) + F.count(F.when(F.col("_own"), 1))).alias("_met"), F.count_distinct("_item").alias("_used"))
    x = sizes.join(x, ["offer", "recipe"], "left")
    return x.select("offer", "recipe", F.coalesce((F.col("_met") == F.col("_need")) & (F.col("_used") == F.col("_have")) & (F.col("_need") == F.col("_have")), F.lit(False)).alias("valid"))


def craftable(names: DataFrame, recipes: DataFrame) -> DataFrame:
    """Names (column item) that some recipe's output has."""
    return names.join(recipes.select(F.col("output").alias("item")).distinct(), "item", "left_semi")


def valid_items(names: DataFrame, recipes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Names that are an output or an input of some recipe."""
    known = recipes.select(F.col("output").alias("item")).union(inputs.select("item")).distinct()
    return names.join(known, "item", "left_semi")


def with_min_inputs(recipes: DataFrame, inputs: DataFrame, n: int) -> DataFrame:
    """(item, recipe) of recipes with n different inputs or more."""
    many = inputs.groupBy("recipe").agg(F.count_distinct("item").alias("_n")).where(F.col("_n") >= n)
    return recipes.join(many, "recipe").select(F.col("output").alias("item"), "recipe")


def with_min_depth(depths: DataFrame, recipes: DataFrame, n: int) -> DataFrame:
    """(item, depth) of craftable items of depth n or more."""
    return craftable(depths, recipes).where(F.col("depth") >= n)


def recipe_text(recipes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(recipe, text): "craft n output using n item, n item", inputs in order of name."""
    i = inputs.groupBy("recipe").agg(F.array_sort(F.collect_list(F.struct("item", "count"))).alias("_i"))
    said = F.array_join(F.transform("_i", lambda x: F.concat(x["count"].cast("string"), F.lit(" "), x["item"])), ", ")
    return recipes.join(i, "recipe").select("recipe", F.concat(F.lit("craft "), F.col("count").cast("string"), F.lit(" "), "output", F.lit(" using "), said).alias("text"))


def parse_recipe(text: Column) -> Column:
    """struct(count, item, parts) of a recipe's text; null where it has another form."""
    form = r"^craft (\d+) (.+?) using (.+)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).cast("int").alias("count"), F.regexp_extract(text, form, 2).alias("item"), F.split(F.regexp_extract(text, form, 3), ", ").alias("parts")))
