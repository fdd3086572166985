"""Shop: keyword searches, reviews, search texts, goals, coverage of attributes and the session of a shopper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import catalog

#: Products that a search returns.
SEARCH_RETURN = 50
#: Products of a list that meet its searches in one group.
LIST_BLOCK = 4096
#: Searches that a product is given with at once.
SEARCH_RUN = 512
#: Pairs of searches and products for one task.
TASK_PAIRS = 1 << 25


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts, the same in every run and engine."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def routed(searches: DataFrame, products: DataFrame, search: str, keywords: str, key: str, attributes: str, category: str, query: str, text: str, k: int = SEARCH_RETURN) -> DataFrame:
    """(search, product, rank) of keyword searches: ``<a> attribute``, ``<c> category``, ``<q> query``, ``<r>`` for random ones, else the k best by BM25.

    A category is the first word after its mark.  Products of the first three
    kinds come in order of key and are all returned.  Random ones are the k of
    least hash in each search's block of the products, so a search isn't paired
    with every product.
    """
    words = F.split(F.trim(F.col(keywords)), r"\s+")
    q = searches.select(F.col(search).alias("search"), F.element_at(words, 1).alias("mark"), F.array_join(F.slice(words, 2, 1000), " ").alias("rest"), F.try_element_at(words, F.lit(2)).alias("second"), F.col(keywords).alias("_k"))
    p = products.select(F.col(key).alias("product"), F.col(attributes).alias("_a"), F.col(category).alias("_c"), F.col(query).alias("_q"), F.col(text).alias("_t"))
    tagged = lambda mark, word: F.concat(F.lit(f"{mark} "), word)
    lists = p.select("product", F.explode(F.array_distinct("_a")).alias("_w")).where("_w is not null").select("product", tagged("<a>", F.col("_w")).alias("_v"))
    lists = lists.union(p.where("_c is not null").select("product", tagged("<c>", F.col("_c")))).union(p.where("_q is not null").select("product", tagged("<q>", F.col("_q"))))
    wanted = q.where("mark in ('<a>', '<c>', '<q>')").select("search", F.when(F.col("mark") == "<c>", tagged("<c>", F.col("second"))).otherwise(F.concat("mark", F.lit(" "), "rest")).alias("_v"))
    listed = listed_products(wanted, lists)
    best = catalog.bm25(p.select("product", "_t"), q.where("mark not in ('<a>', '<c>', '<q>', '<r>')").select("search", F.col("_k").alias("_t")), "product", "search", "_t", k)
    return listed.unionByName(best.select("search", "product", "rank")).unionByName(random_products(q.where("mark = '<r>'"), p, k))


def listed_products(searches: DataFrame, lists: DataFrame, block: int = LIST_BLOCK, run: int = SEARCH_RUN, pairs: int = TASK_PAIRS) -> DataFrame:
    """(search, product, rank) of all products in the list of each search; searches (search, _v), lists (product, _v).

    Places come from the lists, so the pairs, which are as many as their result, are
    never sorted.  A list's searches stand in runs, which meet its products block by
    block, in one task for ``pairs`` pairs.  A product comes with a whole run of
    searches, and the next product with the same run, so that columnar files of the
    result hold a product and its rank once a run and the searches as a repeated pattern.
    """
    from trajecta.operators.batch import with_ordinal

    own = with_ordinal(lists.join(searches.select("_v").distinct(), "_v", "left_semi"), ["_v", "product"], "_pos")
    first = own.groupBy("_v").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    asked = with_ordinal(searches.where("_v is not null"), ["_v", "search"], "_pos")
    size = first.join(asked.groupBy("_v").agg(F.min("_pos").alias("_from"), F.count("*").alias("_m")), "_v")
    total = size.agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    parts = max(int(searches.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // pairs))
    upto = lambda n, k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / k)))
    own = own.join(size, "_v").withColumn("_i", F.col("_pos") - F.col("_first"))
    own = own.select("_v", F.floor(F.col("_i") / block).alias("_b"), upto("_m", run).alias("_r"), "product", (F.col("_i") + 1).cast("int").alias("rank"))
    asked = asked.join(size, "_v").withColumn("_r", F.floor((F.col("_pos") - F.col("_from")) / run))
    asked = asked.groupBy("_v", "_n", "_r").agg(F.sort_array(F.collect_list(F.struct("search"))).alias("_s"))  # structs, so that a null id stays
    asked = asked.select("_v", "_r", F.col("_s")["search"].alias("_s"), upto("_n", block).alias("_b"))
    meet = ["_v", "_b", "_r"]
    # products on the left: what a row of the left side gives is held at once, and here that is one run
    met = own.repartition(parts, *meet).join(asked.repartition(parts, *meet).hint("merge"), meet)
    return met.select(F.explode("_s").alias("search"), "product", "rank")


def random_products(searches: DataFrame, products: DataFrame, k: int) -> DataFrame:
    """For each search k products (all, if there are fewer): its start among the products in hash order is drawn, and the next k follow round the table."""
    from trajecta.operators.batch import with_ordinal

    o = with_ordinal(products.select("product").withColumn("_h", F.md5(F.col("product").cast("string").cast("binary"))), ["_h", "product"], "_pos").drop("_h")
    n = products.agg(F.count("*").alias("_n"))
    at = searches.select("search").join(F.broadcast(n)).withColumn("_s", F.floor(unit_hash(F.lit("r"), F.col("search")) * F.col("_n")))  # one row
    at = at.where("_n > 0").withColumn("rank", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_n").cast("int")))))
    return at.withColumn("_pos", F.pmod(F.col("_s") + F.col("rank") - 1, F.col("_n"))).join(o, "_pos").select("search", "product", "rank")


def with_reviews(products: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Products with the columns of their reviews, null where there are none."""
    return products.join(reviews, key, "left")


def search_text(title: Column, description: Column, bullets: Column, options: Column) -> Column:
    """What the index holds of a product: title, description, first bullet and options (map of name to values, in order of name), in lower case."""
    told = F.transform(F.array_sort(F.map_keys(options)), lambda n: F.concat(n, F.lit(": "), F.array_join(F.element_at(options, n), ", ")))
    return F.lower(F.concat_ws(" ", title, description, F.coalesce(F.try_element_at(bullets, F.lit(1)), F.lit("")), F.array_join(told, ", and ")))


def select_goals(goals: DataFrame, key: str, weight: str, limit: int = -1, rule: Column | None = None, seed: int = 233) -> DataFrame:
    """Goals that meet the rule; of more than ``limit`` of them so many are drawn without replacement by weight.

    Each goal's key is an exponential of rate weight, and the least keys win: a
    top-n, without running sums.  Goals without a positive weight are never drawn.
    """
    met = goals if rule is None else goals.where(rule)
    if limit < 0:
        return met
    e = F.when(F.col(weight) > 0, -F.log(unit_hash(F.lit(seed), F.col(key))) / F.col(weight))
    return met.withColumn("_e", e).where("_e is not null").orderBy("_e", key).limit(limit).drop("_e")


def attribute_coverage(products: DataFrame, key: str, attributes: str, k: int) -> DataFrame:
    """(attribute, products, share): products that have the attribute among their first k, over all products."""
    top = products.select(key, F.explode(F.array_distinct(F.slice(F.col(attributes), 1, k))).alias("attribute"))
    n = products.agg(F.count("*").alias("_n"))
    g = top.groupBy("attribute").agg(F.count("*").alias("products")).join(F.broadcast(n))  # one row
    return g.select("attribute", "products", (F.col("products") / F.col("_n")).alias("share"))


def unique_attributes(products: DataFrame, category: str, attributes: str) -> DataFrame:
    """Distinct attributes of each category."""
    return products.select(category, F.explode(attributes).alias("_a")).groupBy(category).agg(F.count_distinct("_a").alias("n_attributes"))


# Names of the shop's buttons and pages.
BUY, BACK, NEXT, PREV = "buy now", "back to search", "next >", "< prev"
SUB_PAGES = ("description", "features", "reviews", "attributes")


def start_session(goal: str | None = None) -> dict:
    return {"goal": goal, "page": "index", "keywords": None, "number": None, "asin": None, "options": {}, "actions": {}, "reward": 0.0, "done": False}


def shop_step(state: dict, action: str | None, products: dict, reward=None) -> dict:
    """The session after ``search[..]`` or ``click[..]``; what can't be done on the page leaves it as it is.

    products: name to {option name: values}.  Buying ends the session with
    ``reward(goal, asin, options)`` (1 for the goal itself if none is given).
    """
    if state["done"]:
        return state
    s = {**state, "options": dict(state["options"]), "actions": dict(state["actions"])}
    name, _, arg = (action or "").strip().partition("[")
    name, arg = name.strip().lower(), arg.removesuffix("]").strip()
    click = arg.lower()
    if name == "search" and s["page"] == "index" and arg:
        s |= {"page": "results", "keywords": arg, "number": 1}
    elif name == "click" and click == BACK and s["page"] != "index":
        s |= start_session(s["goal"]) | {"actions": s["actions"]}
    elif name == "click" and s["page"] == "results" and click in (NEXT, PREV):
        s["number"] = max(1, s["number"] + (1 if click == NEXT else -1))
    elif name == "click" and s["page"] == "results" and arg in products:
        s |= {"page": "item", "asin": arg, "options": {}}
    elif name == "click" and s["page"] == "sub" and click == PREV:
        s["page"] = "item"
    elif name == "click" and s["page"] == "item" and click == PREV:
        s |= {"page": "results", "asin": None, "options": {}}
    elif name == "click" and s["page"] == "item" and click == BUY:
        got = reward(s["goal"], s["asin"], s["options"]) if reward else float(s["goal"] == s["asin"])
        s |= {"page": "done", "done": True, "reward": float(got)}
    elif name == "click" and s["page"] == "item" and click in SUB_PAGES:
        s["page"] = "sub"
    elif name == "click" and s["page"] == "item" and (kind := next((k for k, v in products[s["asin"]].items() if click in [x.lower() for x in v]), None)):
        s["options"][kind] = click
    else:
        return {**s, "actions": {**s["actions"], "invalid": s["actions"].get("invalid", 0) + 1}}
    s["actions"][name] = s["actions"].get(name, 0) + 1
    return s


# What stands around a goal in a first state, and how choices are reduced.
GOAL_HEADS = ("amazon shopping game\ninstruction:", "webshop\ninstruction:", "\n[button] search [button_]")
PRICE_CLAUSE = ", and price lower than"
MOST_CHOICES, FIRST_CHOICES, DRAWN_CHOICES = 20, 6, 10


def _bare(c: Column) -> Column:
    return F.translate(F.lower(c), "\"'", "")


def plain_state(c: Column) -> Column:
    """Lower case, without quotes; only the mark [SEP] stays as it is."""
    return F.replace(X.strip(_bare(c)), F.lit("[sep]"), F.lit("[SEP]"))


def goal_of(state: Column) -> Column:
    """The goal in a first state: lower case, without quotes, head, search button and price clause."""
    c = _bare(state)
    for head in GOAL_HEADS:
        c = F.replace(c, F.lit(head), F.lit(""))
    return F.element_at(F.split(X.strip(c), PRICE_CLAUSE), 1)


def reduced_choices(actions: Column, chosen: Column, seed: Column, most: int = MOST_CHOICES, first: int = FIRST_CHOICES, drawn: int = DRAWN_CHOICES) -> Column:
    """struct(actions, chosen): over ``most`` actions become the first ones, some of the others by hash, and the chosen one, in their order.

    ``chosen`` counts from 0, before and after.  The hash is that of ``seed``
    and the place, so a retried task draws the same ones.
    """
    places = F.sequence(F.lit(0), F.size(actions) - 1)
    drawn_ones = F.slice(F.array_sort(F.transform(F.filter(places, lambda i: i >= first), lambda i: F.struct(F.md5(F.concat_ws(":", seed, i.cast("string")).cast("binary")).alias("h"), i.alias("i")))), 1, drawn)
    kept = F.array_sort(F.array_distinct(F.concat(F.filter(places, lambda i: i < first), F.transform(drawn_ones, lambda x: x["i"]), F.array(chosen))))
    few = F.transform(F.array(kept), lambda k: F.struct(F.transform(k, lambda i: F.element_at(actions, i + 1)).alias("actions"), (F.array_position(k, chosen).cast("int") - 1).alias("chosen")))[0]
    return F.when(F.size(actions) > most, few).otherwise(F.struct(actions.alias("actions"), chosen.alias("chosen")))


def choice_rows(runs: DataFrame, goals: DataFrame, low: int, high: int | None = None, drop_searches: bool = True) -> tuple[DataFrame, DataFrame]:
    """Steps of the runs whose goal's number is in [low, high), and the runs whose goal is not known.

    runs: run, states array<string>, available_actions array<array<string>>,
    action_idxs array<int>; goals: goal, number (the least one counts).  A run's
    goal is read from its first state.  Steps beyond the shortest
    of the three arrays are left out, and those with the index -1 too unless
    they are asked for.  Rows: run, step, number, state, actions, chosen,
    n_before.
    """
    known = goals.groupBy("goal").agg(F.min("number").alias("number"))
    met = runs.withColumn("goal", goal_of(F.try_element_at("states", F.lit(1)))).join(known, "goal", "left")
    missing = met.where("number is null").select("run", "goal")
    held = met.where(F.col("number") >= low) if high is None else met.where((F.col("number") >= low) & (F.col("number") < high))
    n = F.least(F.size("states"), F.size("available_actions"), F.size("action_idxs"))
    steps = held.select("run", "number", F.posexplode(F.slice(F.arrays_zip("states", "available_actions", "action_idxs"), 1, n)).alias("step", "s"))
    steps = steps.where(F.col("s.action_idxs") != -1) if drop_searches else steps
    few = reduced_choices(F.col("s.available_actions"), F.col("s.action_idxs"), F.concat_ws(":", "run", "step"))
    return steps.select("run", "step", "number", plain_state(F.col("s.states")).alias("state"), few.alias("few"), F.size("s.available_actions").alias("n_before")).select("run", "step", "number", "state", F.transform("few.actions", plain_state).alias("actions"), "few.chosen", "n_before"), missing
