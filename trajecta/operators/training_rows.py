"""Training rows: raw and prefix records, canonical and ranked rows, subsets, metadata, replay manifests and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.operators import messages as M

# Names of the record format.
MESSAGES = "array<struct<role:string,content:string>>"
COORDINATES = "canonicalized_prompt"
#: Fixed value: the source of records unless the caller names another.
SOURCE = "textcraft"
FROM_SAMPLING = "constructed_from_sampling"


def interaction_kwargs(name: str, task: Column, goal: Column, actions: Column) -> Column:
    task = task.cast("int")
    return F.struct(F.lit(name).alias("name"), task.alias("task_id"), task.alias("data_idx"), task.alias("session_id"), goal.alias("goal"), F.lit(False).alias("eval_mode"), actions.alias("prefix_actions"))


def record(df: DataFrame, dataset: str, name: str, variant: Column, raw: bool, strategy: Column, prompt: Column, prefix: Column, rest: Column, category: str, sidecar: dict[str, Column]) -> DataFrame:
    """The columns that all records have, in their order.

    ``df`` has sample_uid, item_id, sample_idx, task_id, goal, data_source,
    ability, reward_model and, where known, index.
    """
    actions = M.actions(prefix)
    index = F.col("index") if "index" in df.columns else F.lit(None).cast("int")
    extra = F.struct(index.alias("index"), interaction_kwargs(name, F.col("task_id"), F.col("goal"), actions).alias("interaction_kwargs"), F.col("sample_uid"), F.lit(dataset).alias("main_dataset"), variant.alias("variant_label"))
    cols = {
        "record_uid": M.record_uid(dataset, F.col("sample_uid"), variant),
        "main_dataset": F.lit(dataset),
        "variant_label": variant,
        "is_raw_variant": F.lit(raw),
        "sample_uid": F.col("sample_uid"),
        "item_id": F.col("item_id"),
        "sample_idx": F.col("sample_idx").cast("int"),
        "task_id": F.col("task_id").cast("int"),
        "goal": F.col("goal"),
        "strategy": strategy,
        "data_source": F.col("data_source"),
        "ability": F.col("ability"),
        "prompt": prompt,
        "reward_model": F.col("reward_model"),
        "extra_info": extra,
        "prefix_messages": prefix,
        "continuation_messages": rest,
        "prefix_actions": actions,
        "replay_category": F.lit(category),
        **sidecar,
        "prefix_coordinate_system": F.lit(COORDINATES),
    }
    return df.select(*[c.alias(k) for k, c in cols.items()])


def sidecar(empty: bool, model: str | None) -> dict[str, Column]:
    """Columns that the log-probability pass fills in: null until then, empty for rows without a prefix."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    made = {"assistant_prefix_old_log_probs": (F.array(), "array<double>"), "prefix_mask": (F.array(), "array<int>"), "prefix_token_count": (F.lit(0), "int"), "assistant_prefix_span": (span, "struct<start:int,end:int>"), "source_oldlogprob_model_path": (F.lit(model), "string")}
    return {k: (c if empty else F.lit(None)).cast(t) for k, (c, t) in made.items()}


def prefix_records(df: DataFrame, dataset: str, system: str, name: str = SOURCE) -> DataFrame:
    """Records of rows cut into ``prefix_messages`` and ``continuation_messages``, with ``strategy`` and ``variant_label``."""
    prompt = M.training_prompt(F.lit(system), F.col("prefix_messages"), F.col("continuation_messages"))
    return record(df, dataset, name, F.col("variant_label"), False, F.col("strategy"), prompt, F.col("prefix_messages"), F.col("continuation_messages"), FROM_SAMPLING, sidecar(False, None))


def raw_records(df: DataFrame, dataset: str, model: str, name: str = SOURCE) -> DataFrame:
    """Records of whole episodes, which start from ``prompt``."""
    none = F.array().cast(MESSAGES)
    return record(df, dataset, name, F.lit("raw"), True, F.lit("raw"), M.normalize(F.col("prompt")), none, none, "raw", sidecar(True, model))


def canonical_rows(df: DataFrame, system: str, name: str = SOURCE, ability: str = "crafting") -> DataFrame:
    """Rows of an earlier build with prompt, source, reward model and extra_info made anew; all other columns stay."""
    reward = F.struct(F.lit("").alias("ground_truth"), F.lit("interaction").alias("style"))
    kwargs = F.struct(F.lit(name).alias("name"), F.col("task_id").cast("int").alias("task_id"), F.lit(False).alias("eval_mode"), F.coalesce("prefix_actions", F.array().cast("array<string>")).alias("prefix_actions"), F.col("goal").alias("goal"))
    extra = F.struct(F.col("sample_idx").cast("int").alias("index"), F.col("sample_uid"), F.col("strategy"), kwargs.alias("interaction_kwargs"), reward.alias("reward_model"))
    prompt = M.training_prompt(F.lit(system), M.normalize(F.col("prefix_messages")), M.normalize(F.col("continuation_messages")))
    return df.withColumns({"data_source": F.lit(name), "ability": F.lit(ability), "prompt": prompt, "reward_model": reward, "extra_info": extra})


def ranked_rows(df: DataFrame, base: DataFrame, dataset: str, name: str = SOURCE) -> DataFrame:
    """Audited candidates as records: the label is their rank, source, ability and reward model are their task's; a task without a base row raises."""
    own = base.select(F.col("task_id").alias("_t"), F.col("data_source").alias("_s"), F.col("ability").alias("_a"), F.col("reward_model").alias("_r"))
    j = df.join(own, df.task_id == own["_t"], "left")
    j = j.where(F.when(F.col("_t").isNotNull(), True).otherwise(F.raise_error(F.lit("candidate of an unknown task")).cast("boolean")))
    label = F.concat(F.lit("rank"), F.col("candidate_rank").cast("int").cast("string"))
    extra = F.struct(interaction_kwargs(name, F.col("task_id"), F.col("goal"), F.coalesce("prefix_actions", F.array().cast("array<string>"))).alias("interaction_kwargs"), F.col("sample_uid"), F.lit(dataset).alias("main_dataset"), label.alias("variant_label"))
    cols = {"record_uid": M.record_uid(dataset, F.col("sample_uid"), label), "main_dataset": F.lit(dataset), "variant_label": label, "is_raw_variant": F.lit(False), "data_source": F.col("_s"), "ability": F.col("_a"), "reward_model": F.col("_r"), "extra_info": extra, "source_dataset": F.lit("entropy_stage7_audited")}
    return j.withColumns(cols).drop("_t", "_s", "_a", "_r")


def debug_subset(df: DataFrame, has_prefix: Column, order: list[str], n: int = 16) -> DataFrame:
    """The first n rows with prefix actions, topped up with rows without (a top-n, not a full sort)."""
    return df.orderBy((~F.coalesce(has_prefix, F.lit(False))).cast("int"), *order).limit(n)


def merge_metadata(records: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records with the columns of their task's metadata where it has them; others keep their own value."""
    m = meta.select(F.col(key).alias("__tj_k"), *[F.col(c).alias(f"__tj_{c}") for c in columns])
    j = records.join(m, F.col(key) == F.col("__tj_k"), "left")
    own = lambda c: F.col(c) if c in records.columns else F.lit(None).cast(meta.schema[c].dataType)
    return j.withColumns({c: F.coalesce(F.col(f"__tj_{c}"), own(c)) for c in columns}).drop("__tj_k", *[f"__tj_{c}" for c in columns])


def replay_manifest(df: DataFrame, strategy: str, category: str, uid: str, usable: list[str]) -> DataFrame:
    """A row for each strategy and category with its rows, and the strategy's candidates, usable rows and distinct uids beside it."""
    own = df.groupBy(strategy, category).agg(F.count("*").alias("rows"))
    total = df.groupBy(F.col(strategy).alias("_s")).agg(F.count("*").alias("candidates"), F.count_if(F.col(category).isin(*usable)).alias("usable"), F.count_distinct(uid).alias("uids"))
    return own.join(total, F.col(strategy).eqNullSafe(F.col("_s"))).drop("_s")


def replay_order(df: DataFrame, group: str, actions: str, order: str) -> DataFrame:
    """``turn`` of each row of a group, shorter action lists first, and ``shared``: how many leading actions it has in common with the row before, which needn't be replayed again."""
    w = Window.partitionBy(group).orderBy(F.size(actions), F.array_join(actions, "\u0001"), order)
    before = F.coalesce(F.lag(actions).over(w), F.array().cast("array<string>"))
    x = df.withColumns({"turn": F.row_number().over(w) - 1, "_b": before})
    same = F.zip_with(F.col("_b"), F.slice(F.col(actions), F.lit(1), F.size("_b")), lambda a, b: a.eqNullSafe(b))
    stop = F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1
    return x.withColumn("shared", stop.cast("int")).drop("_b")
