"""Row builders and checks: nested updates, column unions, flags, splits, recipe sets and rate limits."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.sources.tables import cut


def with_kwargs(extra: Column, **values: Column) -> Column:
    """``extra`` (a struct that holds the struct interaction_kwargs) with some of its fields set."""
    for k, v in values.items():
        extra = extra.withField(f"interaction_kwargs.{k}", v)
    return extra


def reset_key(index: Column, ordinal: Column) -> Column:
    return F.coalesce(index.cast("bigint"), ordinal.cast("bigint"))


def bc_should_train(source: str, is_raw: Column) -> Column:
    """Whether a row is trained on under a source of all, prefix or raw rows."""
    rules = {"all": F.lit(True), "prefix": ~is_raw, "non_raw": ~is_raw, "prefix_only": ~is_raw, "raw": is_raw, "raw_only": is_raw}
    if source.strip().lower() not in rules:
        raise ValueError(f"no source named {source}")
    return rules[source.strip().lower()]


def split_rows(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the rule, and all others (null counts as not met)."""
    met = F.coalesce(rule, F.lit(False))
    return df.where(met), df.where(~met)


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both frames for the same rows; a shared column must be equal in both (NaN and null equal themselves), else it raises."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    y = b.select(F.col(key).alias("__tj_k"), *[F.col(c).alias(f"__tj_{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    j = a.join(y, F.col(key) == F.col("__tj_k"), "full_outer")
    ok = F.col(key).isNotNull() & F.col("__tj_k").isNotNull()
    for c in shared:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__tj_{c}"))
    checked = j.where(F.when(ok, True).otherwise(F.raise_error(F.lit("frames differ in rows or in a shared column")).cast("boolean")))
    return checked.select(*a.columns, *[c for c in b.columns if c not in a.columns])


def require_match(df: DataFrame, found: str, message: str) -> DataFrame:
    """Rows of a left join; one without a match raises."""
    return df.where(F.when(F.col(found).isNotNull(), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def episode_flags(actions: Column, category: Column) -> dict[str, Column]:
    n = F.coalesce(F.size(actions), F.lit(0))
    return {"is_prefix": n > 0, "is_raw": n <= 0, "is_terminal": (n > 0) & F.coalesce(F.lower(category).contains("terminal"), F.lit(False))}


def flag_summary(df: DataFrame, modes: str) -> DataFrame:
    """Sum of the mode-to-count maps of all rows."""
    return df.select(F.explode(modes).alias("mode", "n")).groupBy("mode").agg(F.sum("n").alias("n"))


def drop_summary(df: DataFrame, reason: str, uid: str, examples: int = 20) -> DataFrame:
    """Rows, distinct uids and the first examples of each reason; examples are ranked, so a frequent reason isn't gathered."""
    r = F.row_number().over(Window.partitionBy(reason).orderBy(uid))
    first = df.select(reason, uid).distinct().withColumn("r", r).where(F.col("r") <= examples).groupBy(reason).agg(F.sort_array(F.collect_list(uid)).alias("examples"))
    return df.groupBy(reason).agg(F.count("*").alias("n"), F.count_distinct(uid).alias("uids")).join(first, reason)


def recipe_set(goal_closure: DataFrame, uses: DataFrame, per_item: int = 10, most: int = 10, seed: int = 0) -> DataFrame:
    """(goal, recipe, distractor): recipes of the goal's closure and, by hash, up to ``per_item`` users of each item but ``most`` distractors.

    goal_closure (goal, item, recipe), uses (item, recipe).
    """
    own = goal_closure.select("goal", "recipe").where("recipe is not null").distinct().withColumn("distractor", F.lit(False))
    h = F.xxhash64(F.lit(seed), "goal", "item", "recipe")
    near = goal_closure.select("goal", "item").distinct().join(uses, "item").withColumn("r", F.row_number().over(Window.partitionBy("goal", "item").orderBy(h, "recipe"))).where(F.col("r") <= per_item)
    extra = near.select("goal", "recipe").distinct().join(own, ["goal", "recipe"], "left_anti")
    extra = extra.withColumn("r", F.row_number().over(Window.partitionBy("goal").orderBy(F.xxhash64(F.lit(seed), "goal", "recipe"), "recipe"))).where(F.col("r") <= most)
    return own.unionByName(extra.select("goal", "recipe", F.lit(True).alias("distractor")))


def cached(spark, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path keyed by its settings, made and written if it isn't there."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def cache_valid(cache: DataFrame, rows: DataFrame, uid: str, version: str) -> bool:
    """Whether cache and rows hold the same uids and one version each, the same."""
    a, b = cache.select(uid).distinct(), rows.select(uid).distinct()
    same = a.join(b, uid, "left_anti").isEmpty() and b.join(a, uid, "left_anti").isEmpty()
    kinds = cache.select(version).union(rows.select(version)).distinct().limit(2).collect()
    return same and len(kinds) == 1


class TokenBucket:
    """Rate limit inside one Python worker: ``take`` waits until so many tokens have come in."""

    def __init__(self, rate: float, burst: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.most = rate, burst or rate
        self.have, self.clock, self.sleep, self.at = self.most, clock, sleep, clock()
        self.lock = threading.Lock()

    def take(self, n: float = 1.0) -> float:
        """Seconds waited.  More than a full bucket at once raises."""
        if n > self.most:
            raise ValueError("more tokens than the bucket holds")
        with self.lock:
            now = self.clock()
            self.have = min(self.most, self.have + (now - self.at) * self.rate)
            self.at = now
            wait = max(0.0, (n - self.have) / self.rate)
            self.have -= n
        if wait:
            self.sleep(wait)
        return wait


def controller(values: list[float], start: float, target: float, horizon: float) -> list[float]:
    """Penalty weight after each batch: multiplied by one plus the clipped relative error times n / horizon."""
    out, beta = [], start
    for v in values:
        beta *= 1 + max(-0.2, min(0.2, v / target - 1)) / horizon
        out.append(beta)
    return out


def resume_eval(done: DataFrame, todo: DataFrame, task: str, sample: str, order: str) -> DataFrame:
    """Samples still to run: those whose (task, sample) has no record; of repeated records the first counts."""
    first = done.where(F.col(task).isNotNull() & F.col(sample).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(task, sample).orderBy(order))).where("r = 1")
    return todo.join(first.select(task, sample), [task, sample], "left_anti")


def read_recipes(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(recipe, output, count) and (recipe, name, is_tag, count) of a folder of recipe files, shaped or shapeless.

    Inputs may be an item, a tag or a list of such (the first counts); files are
    numbered by name, so the order of listing doesn't matter.
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("recipe"), "value")
    get = lambda p: F.get_json_object("value", p)
    kind = F.regexp_replace(get("$.type"), "^.*:", "")
    base = cut(raw.select("recipe", kind.alias("type"), F.coalesce(get("$.result.item"), get("$.result")).alias("output"), F.coalesce(get("$.result.count").cast("int"), F.lit(1)).alias("count"), F.from_json(get("$.ingredients"), "array<string>").alias("parts"), F.from_json(get("$.key"), "map<string,string>").alias("key"), F.from_json(get("$.pattern"), "array<string>").alias("pattern")).where(F.col("type").isin("crafting_shaped", "crafting_shapeless")))
    loose = base.where("type = 'crafting_shapeless'").select("recipe", F.explode("parts").alias("part"))
    chars = base.where("type = 'crafting_shaped'").select("recipe", "key", F.explode(F.filter(F.split(F.array_join("pattern", ""), ""), lambda c: F.trim(c) != "")).alias("c"))
    shaped = chars.select("recipe", F.element_at("key", F.col("c")).alias("part"))
    one = lambda p, f: F.coalesce(F.get_json_object(p, f"$.{f}"), F.get_json_object(p, f"$[0].{f}"))
    inputs = loose.unionByName(shaped).select("recipe", F.coalesce(one("part", "item"), one("part", "tag")).alias("name"), one("part", "item").isNull().alias("is_tag")).groupBy("recipe", "name", "is_tag").agg(F.count("*").alias("count"))
    return base.select("recipe", "output", "count"), inputs
