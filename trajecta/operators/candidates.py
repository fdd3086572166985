"""Candidate prefixes checked, parsed again and matched, and demonstrations met with their baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import messages as M

# Reasons and sources.
NO_ACTIONS = "no_runtime_actions_after_filter"
PARSED_MODES = ("bracket", "line")


def tag_count(content: Column) -> Column:
    return F.size(X.action_lines(content))


def invalid_details(messages: Column) -> Column:
    """array<struct(place, turn, reason, tags)> of the assistant messages that an environment would refuse."""
    bad = M.invalid_turns(messages)
    return F.transform(bad, lambda x: F.struct(x["place"].cast("int").alias("place"), x["turn"].cast("int").alias("turn"), x["reason"].alias("reason"), tag_count(F.element_at(messages, x["place"].cast("int") + 1)["content"]).alias("tags")))


def split_runtime_invalid(rows: DataFrame, messages: str = "prefix_messages", actions: str = "prefix_actions", raw: str = "is_raw_variant") -> tuple[DataFrame, DataFrame]:
    """Rows that can be replayed, and the others with ``runtime_invalid_details`` and ``runtime_invalid_reasons``.

    Raw rows are always kept.  A prefix goes if one of its assistant messages is
    refused, or if it holds no action at all; then the one detail has the places
    -1.  Null messages and actions count as none.
    """
    detail = "array<struct<place:int,turn:int,reason:string,tags:int>>"
    found = F.when(F.col(messages).isNotNull(), invalid_details(F.col(messages))).otherwise(F.array().cast(detail)).cast(detail)
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit(-1).alias("turn"), F.lit(NO_ACTIONS).alias("reason"), F.lit(0).alias("tags"))).cast(detail)
    is_raw = F.coalesce(F.col(raw), F.lit(False))
    no_actions = F.coalesce(F.size(actions), F.lit(0)) <= 0
    x = rows.withColumn("runtime_invalid_details", F.when(is_raw, F.array().cast(detail)).when(F.size(found) > 0, found).when(no_actions, none).otherwise(F.array().cast(detail)))
    kept = x.where(F.size("runtime_invalid_details") == 0).drop("runtime_invalid_details")
    dropped = x.where(F.size("runtime_invalid_details") > 0).withColumn("runtime_invalid_reasons", F.transform("runtime_invalid_details", lambda z: z["reason"]))
    return kept, dropped


def reparsed(messages: Column) -> Column:
    """struct(actions, details, summary): a prefix's actions found loosely, turn by turn, and how they were found.

    Warm-up messages count as turns and give no action.  ``summary`` has the
    numbers of actions, turns, turns without the warm-ups, turns without an
    action and with more than one action line, the histogram of the modes, and
    whether no action was found.  Null messages are read as none.
    """
    said = F.filter(F.transform(M.normalize(messages), lambda m, i: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), i.alias("place"))), lambda m: m["role"] == "assistant")

    seen = F.transform(said, lambda m: F.struct(m["place"].alias("place"), m["content"].contains(X.WARMUP_ASSISTANT).alias("warm"), X.action_loose(m["content"]).alias("got"), tag_count(m["content"]).alias("tags")))

    def detail(m: Column, turn: Column) -> Column:
        found = ~m["warm"] & m["got"]["action"].isNotNull()
        return F.struct(m["place"].alias("place"), turn.alias("turn"), m["warm"].alias("is_warmup"), F.when(m["warm"], 0).otherwise(m["tags"]).alias("tags"), F.when(found, m["got"]["action"]).alias("action"), F.when(found, m["got"]["mode"]).alias("mode"))

    def whole(ds: Column) -> Column:
        count = lambda rule: F.size(F.filter(ds, rule))
        by = lambda mode: lambda d: F.coalesce(d["mode"] == mode, F.lit(False))
        modes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, PARSED_MODES)), F.array(*(count(by(m)) for m in PARSED_MODES))), lambda _, n: n > 0)
        actions = F.transform(F.filter(ds, lambda d: d["action"].isNotNull()), lambda d: d["action"])
        talked = count(lambda d: ~d["is_warmup"])
        summary = F.struct(F.size(actions).alias("actions"), F.size(ds).alias("turns"), talked.alias("turns_without_warmup"), (talked - F.size(actions)).alias("missing"), count(lambda d: d["tags"] > 1).alias("several"), modes.alias("modes"), (F.size(actions) == 0).alias("empty"))
        return F.struct(actions.alias("actions"), ds.alias("details"), summary.alias("summary"))

    return F.transform(F.array(F.transform(seen, detail)), whole)[0]


def matched_candidates(candidates: DataFrame, teachers: DataFrame, bases: DataFrame, sample: str = "sample_uid", task: str = "task_id") -> DataFrame:
    """Candidates with the columns of their sample's teacher row and of their task's base row; one without either raises.

    Of several rows for a sample or a task any one is taken, by the least of
    their hashes.  Teacher columns are named ``teacher_*`` and base columns
    ``base_*``.
    """

    def one(df: DataFrame, key: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        row = F.struct(F.xxhash64(*rest).alias("h") if rest else F.lit(0).alias("h"), *rest)
        return df.groupBy(F.col(key).alias(f"__{name}")).agg(F.min_by(row, row["h"]).alias("r")).select(f"__{name}", *(F.col("r")[c].alias(f"{name}_{c}") for c in rest))

    def must(found: Column, what: str, key: str) -> Column:
        return F.when(found.isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"no {what} row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))

    x = candidates.join(one(teachers, sample, "teacher"), F.col(sample) == F.col("__teacher"), "left").join(one(bases, task, "base"), F.col(task) == F.col("__base"), "left")
    return x.where(must(F.col("__teacher"), "teacher", sample)).where(must(F.col("__base"), "base", task)).drop("__teacher", "__base")


def raw_reward_means(batch: DataFrame, sample: str = "sample_uid", reward: str = "reward", raw: str = "is_raw_variant", label: str = "variant_label") -> DataFrame:
    """(sample, raw_mean): the mean reward of each sample's raw rows; samples without one have no row."""
    return batch.where(M.is_raw(F.col(raw), F.col(label))).groupBy(sample).agg(F.avg(F.col(reward).cast("double")).alias("raw_mean"))


def demo_batch(demos: DataFrame, means: DataFrame, width: int, pad: int, weight: float = 1.0, skip_overlong: bool = True, sample: str = "sample_uid") -> tuple[DataFrame, DataFrame]:
    """Demonstrations over their raw baseline, padded to ``width``, and one row of counts.

    demos: sample, response_ids array<int>, attention array<int> (null: all 1),
    loss_mask array<float>, old_log_probs array<float>, reward.  A sample without
    a baseline is left out and counted.  Of the others, arrays of different
    lengths and a response without a token to learn raise; a response longer
    than ``width`` is left out and counted, or raises unless ``skip_overlong``.
    The advantage is the reward over the baseline, between 0 and 1; the score
    stands at the last attended place.
    """
    attention = F.coalesce("attention", F.transform("response_ids", lambda _: F.lit(1)))
    x = demos.withColumn("attention", attention).join(means.select(F.col(sample).alias("__s"), "raw_mean"), F.col(sample) == F.col("__s"), "left").drop("__s")
    sizes = [F.coalesce(F.size(c), F.lit(-1)) for c in ("response_ids", "attention", "loss_mask", "old_log_probs")]
    uneven = sizes[0] != sizes[1]
    for s in sizes[2:]:
        uneven = uneven | (s != sizes[0])
    long = F.size("response_ids") > width
    learned = F.aggregate("loss_mask", F.lit(0.0), lambda a, v: a + v) > 0
    stop = lambda text: F.raise_error(F.concat(F.lit(f"{text}: "), F.coalesce(F.col(sample).cast("string"), F.lit("null")))).cast("string")
    state = F.when(F.col("raw_mean").isNull(), "missing_raw_baseline").when(uneven, stop("arrays of different lengths")).when(long, F.lit("overlong") if skip_overlong else stop("a response longer than the batch")).when(~learned, stop("no token to learn")).otherwise("kept")
    x = x.withColumn("state", state)
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    counts = x.agg(F.count("*").alias("source_rows"), count("kept").alias("kept_rows"), count("missing_raw_baseline").alias("missing_raw_baseline_rows"), count("overlong").alias("overlong_rows"))
    fill = lambda c, v, kind: F.concat(F.col(c).cast(f"array<{kind}>"), F.array_repeat(F.lit(v).cast(kind), F.lit(width) - F.size(c)))
    last = F.array_max(F.transform("attention", lambda v, i: F.when(v > 0, i)))
    kept = x.where("state = 'kept'")
    advantage = F.greatest(F.least(F.col("reward") - F.col("raw_mean"), F.lit(1.0)), F.lit(0.0))
    kept = kept.withColumns({"advantage": advantage, "score_at": last}).select(
        *(c for c in demos.columns if c not in ("response_ids", "attention", "loss_mask", "old_log_probs")),
        "raw_mean",
        "advantage",
        fill("response_ids", pad, "bigint").alias("responses"),
        fill("attention", 0, "int").alias("response_attention"),
        fill("loss_mask", 0.0, "double").alias("response_mask"),
        fill("old_log_probs", 0.0, "double").alias("old_log_probs"),
        F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("score_at"), F.col("reward").cast("double")).otherwise(0.0)).alias("token_scores"),
        F.transform(fill("loss_mask", 0.0, "double"), lambda m: F.col("advantage") * weight * m).alias("advantages"),
    )
    return kept, counts


def canonical_trajectory(samples: DataFrame, system: str, messages: str = "conversations", item: str = "item_id", index: str = "sample_idx") -> DataFrame:
    """Whole runs in one form: episode_messages, canonical_messages (the system prompt before them), goal and sample_uid.

    Warm-up messages of both sides and those of other roles go, and assistant
    texts get their canonical form.  A run that then does not begin with a user
    message raises.  Null texts are read as empty.
    """
    role, text = lambda m: m["role"], lambda m: F.coalesce(m["content"], F.lit(""))
    stays = F.filter(M.normalize(F.col(messages)), lambda m: (role(m) == "user") & ~X.is_warmup_user(text(m)) | (role(m) == "assistant") & ~text(m).contains(X.WARMUP_ASSISTANT))
    episode = F.transform(stays, lambda m: F.struct(role(m).alias("role"), F.when(role(m) == "assistant", X.canonical_assistant(text(m))).otherwise(text(m)).alias("content")))
    x = samples.withColumn("episode_messages", episode)
    first = F.try_element_at("episode_messages", F.lit(1))
    x = x.where(F.when(first["role"] == "user", True).otherwise(F.raise_error(F.concat(F.lit("no first user message in "), F.col(item).cast("string"))).cast("boolean")))
    lead = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return x.withColumns({"canonical_messages": F.concat(lead, "episode_messages"), "goal": X.goal(F.try_element_at("episode_messages", F.lit(1))["content"]), "sample_uid": F.concat(F.col(item).cast("string"), F.lit("::"), F.col(index).cast("string"))})


_tokenizers: dict = {}


def token_counter(path: str, most: int):
    """Pandas UDF: the number of tokens of a text by a tokenizer file; a text that can't be read counts as ``most`` + 1."""
    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            _tokenizers[path] = Tokenizer.from_file(path)

        def one(t) -> int:
            try:
                return len(_tokenizers[path].encode(t, add_special_tokens=False).ids)
            except Exception:  # whatever is wrong with a row, the row goes
                return most + 1

        return texts.map(one, na_action=None).astype("int32")

    return count


def within_tokens(df: DataFrame, prompt: Column, path: str, most: int) -> DataFrame:
    """Rows whose prompt has ``most`` tokens at most.  Prompts that can't be tokenised, null ones among them, go."""
    return df.where(token_counter(path, most)(prompt) <= most)
