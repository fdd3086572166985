"""Shop catalogue: goals, option products, keyword search, TF-IDF and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import text as X

# BM25 parameters.
K1, B = 0.9, 0.4


def option_combinations(options: Column) -> Column:
    """All choices of one value for each option name, in order of the names; no options give one empty choice.

    options: map<string, array<string>>.
    """
    names = F.array_sort(F.map_keys(options))
    empty = F.array(F.array().cast("array<string>"))
    return F.aggregate(names, empty, lambda acc, n: F.flatten(F.transform(acc, lambda c: F.transform(F.element_at(options, n), lambda v: F.concat(c, F.array(F.concat(n, F.lit(": "), v)))))))


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of lower-case words."""
    w = F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != ""))
    return df.select(key, w.alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int = 50) -> DataFrame:
    """The k best documents for each query by BM25; ties go to the lower document.

    Postings are restricted to the queries' terms before they meet, so frequent
    words of no query are never shuffled.  A score depends on a query's set of
    terms alone, so queries with equal sets are scored once.
    """
    post = terms(docs, doc, text)
    size = post.groupBy(doc).agg(F.sum("tf").alias("len"))
    stats = size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    q = queries.select(query, F.explode(F.array_distinct(F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != ""))).alias("term"))
    q = q.groupBy(query).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    sets = q.select("terms").distinct().withColumn("term", F.explode("terms"))
    hit = post.join(sets.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    scored = hit.join(df, "term").join(size, doc).join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = scored.select(doc, "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).alias("s"))
    total = scored.join(sets, "term").groupBy("terms", doc).agg(F.sum("s").alias("score"))
    # scores are rounded before ranking, so sums in another order rank alike
    total = total.withColumn("score", F.round("score", 6))
    r = F.row_number().over(Window.partitionBy("terms").orderBy(F.desc("score"), doc))
    return q.join(total.withColumn("rank", r).where(F.col("rank") <= k), "terms").select(query, doc, "score", "rank")


def tfidf(docs: DataFrame, category: str, key: str, text: str, top: int, features: int = 1000) -> DataFrame:
    """Top one- and two-word terms of each category by summed tf * (log((1 + n) / (1 + df)) + 1), among its most frequent ones."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9]+"), lambda x: x != "")
    d = docs.select(category, key, words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i, F.lit(2))))
    grams = d.select(category, key, F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("gram"))
    tf = grams.groupBy(category, key, "gram").agg(F.count("*").alias("tf"))
    g = tf.groupBy(category, "gram").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    g = g.withColumn("r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("total"), "gram"))).where(F.col("r") <= features)
    n = docs.groupBy(category).agg(F.count_distinct(key).alias("n"))
    w = g.join(n, category).withColumn("weight", F.round(F.col("total") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1), 6))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("weight"), "gram"))).where(F.col("rank") <= top).select(category, "gram", "df", "total", "weight", "rank")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != ""))


_WORD_BITS = 60


def bound(c: Column, f) -> Column:
    """``f`` of a value that is worked out once: a Column named twice inside a lambda is worked out twice."""
    return F.transform(F.array(c), f)[0]


def common_letters(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by bit vectors of 60 letters a word.

    A set bit of the state marks a letter of ``a`` that no step has matched; a
    letter of ``b`` adds its places to the state word by word, with carries.
    """
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    full = F.lit((1 << _WORD_BITS) - 1)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    shift = lambda c, n: F.call_function("shiftleft", c, n)

    def places(own: Column, letter: Column) -> Column:
        return F.aggregate(own, F.struct(zero.alias("m"), one.alias("bit")), lambda s, l: F.struct(F.when(l == letter, s["m"] + s["bit"]).otherwise(s["m"]).alias("m"), (s["bit"] * 2).alias("bit")), lambda s: s["m"])

    def run(x: Column, y: Column, words: Column) -> Column:
        def step(state: Column, letter: Column) -> Column:
            start = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("carry"))

            def add(s: Column, w: Column) -> Column:
                z = F.struct(F.element_at(state, w["i"] + 1).alias("v"), places(w["own"], letter).alias("m"))
                # v plus its matched places, and the places that are not matched
                t = bound(z, lambda z: F.struct((z["v"] + z["v"].bitwiseAND(z["m"]) + s["carry"]).alias("t"), z["v"].bitwiseAND(F.bitwise_not(z["m"])).alias("r")))
                return bound(t, lambda t: F.struct(F.concat(s["out"], F.array(t["t"].bitwiseAND(full).bitwiseOR(t["r"]))).alias("out"), F.shiftright(t["t"], _WORD_BITS).alias("carry")))

            return F.aggregate(words, start, add, lambda s: s["out"])

        end = F.aggregate(y, F.transform(words, lambda w: full), step)
        bits = lambda w: F.least(F.greatest(F.size(x) - w * _WORD_BITS, F.lit(0)), F.lit(_WORD_BITS))
        left = F.transform(end, lambda v, w: F.bit_count(v.bitwiseAND(shift(one, bits(w)) - 1)).cast("int"))
        return F.size(x) - F.aggregate(left, F.lit(0), lambda s, v: s + v)

    def cut(z: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(z["x"]) / _WORD_BITS).cast("int"), F.lit(1)) - 1)
        words = F.transform(at, lambda w: F.struct(w.alias("i"), F.slice(z["x"], w * _WORD_BITS + 1, F.lit(_WORD_BITS)).alias("own")))
        return F.struct(z["x"].alias("x"), z["y"].alias("y"), words.alias("words"))

    parts = bound(F.struct(letters(a).alias("x"), letters(b).alias("y")), cut)
    return bound(parts, lambda z: run(z["x"], z["y"], z["words"]))


def letter_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence over both lengths, so that a substitution costs as much as a letter less and a letter more."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 100.0).when(a == b, 100.0).otherwise(200.0 * common_letters(a, b) / F.greatest(n, F.lit(1)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100, rounded: 100 where one token set holds the other, else the best ``letter_ratio`` of the common tokens and either side's sorted tokens; 0 where a side has none."""
    begins = lambda s0, p: 200.0 * F.length(s0) / F.greatest(F.length(s0) + F.length(p), F.lit(1))  # noqa: E731  s0 is a prefix of p

    def split(t: Column) -> Column:
        x, y = t["x"], t["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.array_sort(F.array_intersect(x, y)).alias("both"), F.array_sort(F.array_except(x, y)).alias("one"), F.array_sort(F.array_except(y, x)).alias("two"))

    def texts(t: Column) -> Column:
        s0 = F.array_join(t["both"], " ")
        return F.struct(s0.alias("s0"), F.trim(F.concat_ws(" ", s0, F.array_join(t["one"], " "))).alias("s1"), F.trim(F.concat_ws(" ", s0, F.array_join(t["two"], " "))).alias("s2"))

    def best(t: Column) -> Column:
        ratio = bound(texts(t), lambda s: F.greatest(F.when(F.size(t["both"]) > 0, F.greatest(begins(s["s0"], s["s1"]), begins(s["s0"], s["s2"]))).otherwise(0.0), letter_ratio(s["s1"], s["s2"])))
        return F.when((F.size(t["x"]) == 0) | (F.size(t["y"]) == 0), 0.0).when((F.size(t["both"]) > 0) & ((F.size(t["one"]) == 0) | (F.size(t["two"]) == 0)), 100.0).otherwise(F.round(ratio))

    return bound(bound(F.struct(token_set(a).alias("x"), token_set(b).alias("y")), split), best)


def attribute_hits(wanted: Column, attributes: Column, text: Column) -> Column:
    """Number of wanted attributes found among the product's, or in its text."""
    return F.size(F.filter(wanted, lambda g: F.exists(attributes, lambda p: token_set_ratio(p, g) > 85) | F.contains(F.lower(text), g)))


def option_hits(wanted: Column, chosen: Column, colors: list[str]) -> Column:
    n = lambda c: X.normalize_color(c, colors)
    return F.size(F.filter(wanted, lambda g: F.exists(chosen, lambda p: token_set_ratio(n(p), n(g)) > 85)))


def category_match(a: Column, b: Column) -> Column:
    part = lambda c: F.array_distinct(F.transform(F.split(c, "›"), lambda x: F.trim(x)))
    return F.size(F.array_intersect(part(a), part(b))) >= 2


def type_reward(query_match: Column, cat_match: Column, title_score: Column) -> Column:
    return F.when(title_score == 0.0, 0.0).when(title_score < 0.1, 0.1).when(query_match | cat_match | (title_score > 0.2), 1.0).otherwise(0.5)


def total_reward(attr: Column, option: Column, price_ok: Column, n_attr: Column, n_option: Column, r_type: Column) -> Column:
    return (attr + option + price_ok.cast("int")) / (n_attr + n_option + 1) * r_type


def attribute_weights(products: DataFrame, key: str, attributes: str) -> DataFrame:
    """Mean of the inverse frequencies of each product's attributes."""
    e = products.select(key, F.explode(attributes).alias("a"))
    freq = e.groupBy("a").agg(F.count("*").alias("c"))
    return e.join(freq, "a").groupBy(key).agg(F.avg(1 / F.col("c")).alias("weight"))


def page(df: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)
