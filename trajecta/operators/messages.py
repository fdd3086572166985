"""Conversations as arrays of (role, content): cuts, prompts, counters and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions import text as X


def gather(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """One row for each conversation with its messages in order of turn."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def normalize(messages: Column) -> Column:
    return F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>"))


def role_counter(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """Running number of the role's turns, and each turn's relative place in its conversation."""
    w = Window.partitionBy(key)
    rank = F.row_number().over(w.orderBy(turn))
    return df.withColumns({"role_turn": F.row_number().over(Window.partitionBy(key, role).orderBy(turn)), "place": (rank - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))})


def assistant_places(messages: Column) -> Column:
    """Places (from 0) of the assistant messages."""
    return F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())


def cut_turn(n: Column, share: float) -> Column:
    """Least turn whose place turn / (n - 1) reaches the share; 0 for one turn or none."""
    hit = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda t: t / F.greatest(n - 1, F.lit(1)) >= share)
    return F.when(n <= 1, 0).otherwise(F.coalesce(F.try_element_at(hit, F.lit(1)), n - 1))


def split_at(messages: Column, turn: Column) -> tuple[Column, Column]:
    """Messages up to the given assistant turn, and the rest; without assistant turns all are rest."""
    at = assistant_places(messages)
    last = F.try_element_at(at, F.least(turn, F.size(at) - 1) + 1)
    cut = F.when(F.size(at) == 0, 0).otherwise(last + 1)
    return F.slice(messages, F.lit(1), cut), F.slice(messages, cut + 1, F.greatest(F.size(messages) - cut, F.lit(0)))


def training_prompt(system: Column, prefix: Column, rest: Column) -> Column:
    """System message, the prefix without warm-ups and in canonical form, then the first user message of the rest."""
    kept = F.filter(prefix, lambda m: ~((m["role"] == "user") & X.is_warmup_user(m["content"])) & ~((m["role"] == "assistant") & m["content"].contains(X.WARMUP_ASSISTANT)))
    done = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "assistant", X.canonical_assistant(m["content"])).otherwise(m["content"]).alias("content")))
    first = F.slice(F.filter(rest, lambda m: m["role"] == "user"), 1, 1)
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), done, first)


def demo_messages(prompt: Column, rest: Column) -> Column:
    """The rest without a first message that repeats the prompt's last, with a flag on assistant rows."""
    same = F.try_element_at(prompt, F.lit(-1)) == F.try_element_at(rest, F.lit(1))
    body = F.when(F.coalesce(same, F.lit(False)), F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))).otherwise(rest)
    return F.transform(body, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), (m["role"] == "assistant").cast("int").alias("train")))


def count_role(messages: Column, role: str) -> Column:
    return F.size(F.filter(messages, lambda m: m["role"] == role))


def labels(df: DataFrame, rest: str = "continuation", raw: str = "is_raw", place: str = "place") -> DataFrame:
    """Remaining turns and steps, stage of the cut in thirds and the row's type."""
    a, u, is_raw, q = count_role(F.col(rest), "assistant"), count_role(F.col(rest), "user"), F.col(raw), X.null_safe_double(F.col(place))
    ends = ~is_raw & (a == 0) & (u == 1)
    return df.withColumns(
        {
            "remaining_turns": F.when(~is_raw, a),
            "remaining_steps": F.when(~is_raw, F.greatest(u - 1, F.lit(0))),
            "cut_stage": F.when(is_raw, "raw").when(q.isNull(), "unknown").when(q <= 1.0 / 3.0, "early").when(q <= 2.0 / 3.0, "mid").otherwise("late"),
            "terminal_like": ends,
            "row_type": F.when(is_raw, "raw").when(ends, "prefix_terminal_like").otherwise("prefix_non_terminal"),
        }
    )


def invalid_turns(messages: Column) -> Column:
    """array<struct(place, turn, reason)> of the assistant messages that are invalid at run time."""
    at = assistant_places(messages)
    seen = F.transform(at, lambda p, i: F.struct(p.alias("place"), i.alias("turn"), X.action_status(F.element_at(messages, p + 1)["content"]).alias("reason")))
    return F.filter(seen, lambda x: x["reason"].isNotNull())


def actions(messages: Column) -> Column:
    return F.filter(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: X.action_strict(m["content"])), lambda a: a.isNotNull())


def is_raw(flag: Column, label: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(label) == "raw", F.lit(False))


def record_uid(dataset: str, sample: Column, variant: Column) -> Column:
    return F.concat_ws("::", F.lit(dataset), sample, variant)


def parse_uid(uid: Column) -> Column:
    """struct(dataset, sample, variant) of a record's key: the first and the last part, and all between them; null for a key of fewer than three parts."""
    parts = F.split(uid, "::")
    n = F.size(parts)
    return F.when(n >= 3, F.struct(parts[0].alias("dataset"), F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), "::").alias("sample"), F.try_element_at(parts, F.lit(-1)).alias("variant")))


def variants(df: DataFrame, key: str, shares: list[float]) -> DataFrame:
    """Prefix rows at fixed shares, followed by one raw row: (key, variant, is_raw, place, prefix, continuation)."""
    n = count_role(F.col("messages"), "assistant")
    names = F.array(*[F.struct(F.lit(f"fixed_{str(s).replace('.', 'p')}").alias("variant"), F.lit(False).alias("is_raw"), cut_turn(n, s).alias("turn")) for s in shares], F.struct(F.lit("raw").alias("variant"), F.lit(True).alias("is_raw"), F.lit(0).alias("turn")))
    x = df.withColumn("n", n).withColumn("v", F.explode(names))
    prefix, rest = split_at(F.col("messages"), F.col("v.turn"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return x.select(key, "v.variant", "v.is_raw", F.when(F.col("n") > 1, F.col("v.turn") / (F.col("n") - 1)).otherwise(0.0).alias("place"), F.when(F.col("v.is_raw"), empty).otherwise(prefix).alias("prefix"), F.when(F.col("v.is_raw"), F.col("messages")).otherwise(rest).alias("continuation"))


def preference(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """The two rows of a preference pair, the chosen first: array<struct(kind, messages)> of the prompt with either answer after it."""
    row = lambda kind, m: F.struct(F.lit(kind).alias("kind"), F.concat(prompt, F.array(m)).alias("messages"))
    return F.array(row("chosen", chosen), row("rejected", rejected))


def encoded_targets(messages: Column, encode, fill: int, most: int) -> tuple[Column, Column]:
    """Token ids of all messages and, beside them, 1 for the ids of messages to be trained on; cut at ``most`` and filled up to it.

    ``encode`` maps a message's struct (role, content, train) to its array of
    ids.
    """
    parts = F.transform(messages, lambda m: F.struct(encode(m).alias("ids"), m["train"].alias("train")))
    ids = F.slice(F.flatten(F.transform(parts, lambda p: p["ids"])), 1, most)
    mask = F.slice(F.flatten(F.transform(parts, lambda p: F.transform(p["ids"], lambda _: p["train"]))), 1, most)
    more = F.greatest(F.lit(most) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(fill), more)), F.concat(mask, F.array_repeat(F.lit(0), more))


# How a context is estimated and cut.
CHARS_A_TOKEN, TOKENS_A_MESSAGE, TOKENS_AROUND = 3, 12, 16
CUT_MARK = "\n...[TRUNCATED HISTORY]...\n"
LEAST_TOKENS, LEAST_CHARS, LEAST_SIDE = 32, 64, 16


def estimated(c: Column) -> Column:
    """Tokens of a text by its length; 0 for an empty or null one."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / CHARS_A_TOKEN).cast("int")


def cut_middle(c: Column, tokens: Column) -> Column:
    """A longer text without its middle, a mark in its place; at least 64 characters stay."""
    most = F.greatest(F.lit(LEAST_CHARS), tokens * CHARS_A_TOKEN)
    keep = most - len(CUT_MARK)
    head = F.greatest(F.lit(LEAST_SIDE), F.floor(keep / 2)).cast("int")
    tail = F.greatest(F.lit(LEAST_SIDE), keep - head).cast("int")
    return F.when((estimated(c) <= tokens) | (F.length(c) <= most), c).otherwise(F.concat(F.substring(c, F.lit(1), head), F.lit(CUT_MARK), F.right(c, tail)))


def trim_history(messages: Column, budget: int, recent: int, system_tokens: int = 0) -> Column:
    """struct(messages, removed, shortened): a conversation cut to a token budget.

    The first message and the last ``recent`` ones stay.  Those between go in
    pairs, the oldest first, until the rest fits.  If it does not fit then, the
    longest message but the first (the first one if it stands alone) loses its
    middle, to half its tokens but 32 at least, again and again until all fit or
    nothing gets shorter.  How many go is found on running sums; every
    shortening halves a message, so the rounds are bounded by the sum of the
    logarithms of the lengths.  Null messages give null, none give none.
    """
    n, around = F.size(messages), system_tokens + TOKENS_AROUND
    sizes = F.transform(messages, lambda m: estimated(m["content"]) + TOKENS_A_MESSAGE)
    total = lambda xs: F.aggregate(xs, F.lit(around), lambda a, x: a + x)
    most = F.greatest(n - 1 - recent, F.lit(0))

    def drop(s: Column, x: Column) -> Column:
        """Message number i is reached: it goes if it begins a pair that must go, or ends one."""
        i, must = s["i"], s["left"] > budget
        goes = (i >= 1) & (i <= most) & ((i % 2 == 0) & (s["gone"] == i - 1) | (i % 2 == 1) & (s["gone"] == i - 1) & must)
        return F.struct((i + 1).alias("i"), F.when(goes, s["left"] - x).otherwise(s["left"]).alias("left"), F.when(goes, s["gone"] + 1).otherwise(s["gone"]).alias("gone"))

    def trimmed(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), total(sizes).alias("left"), F.lit(0).alias("gone"))
        gone = F.aggregate(sizes, start, drop, lambda s: s["gone"])
        return F.transform(F.array(gone), lambda g: F.struct(g.alias("removed"), F.when(n > 0, F.concat(F.slice(messages, 1, 1), F.slice(messages, g + 2, F.greatest(n - g - 1, F.lit(0))))).otherwise(messages).alias("kept")))[0]

    def shortened(t: Column) -> Column:
        texts = F.transform(t["kept"], lambda m: F.coalesce(m["content"], F.lit("")))
        rounds = F.aggregate(texts, F.lit(1), lambda a, x: a + F.greatest(F.ceil(F.log2(F.greatest(estimated(x), F.lit(1)) / 16.0)), F.lit(0)).cast("int") + 1)

        def one(s: Column, _: Column) -> Column:
            xs = s["texts"]
            size = lambda ys: F.aggregate(ys, F.lit(around), lambda a, x: a + estimated(x) + TOKENS_A_MESSAGE)
            longest = F.array_max(F.transform(xs, lambda x, i: F.when((x != "") & ((i > 0) | ~F.exists(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda y: y != "")), F.struct(estimated(x).alias("tokens"), (-i).alias("at")))))
            new = cut_middle(F.element_at(xs, 1 - longest["at"]), F.greatest(F.lit(LEAST_TOKENS), F.floor(longest["tokens"] / 2)).cast("int"))
            able = ~s["stuck"] & (size(xs) > budget) & longest.isNotNull()
            changed = able & (new != F.element_at(xs, 1 - longest["at"]))
            return F.struct(F.when(F.coalesce(changed, F.lit(False)), F.transform(xs, lambda x, i: F.when(i == -longest["at"], new).otherwise(x))).otherwise(xs).alias("texts"), (~F.coalesce(changed, F.lit(False))).alias("stuck"), (s["cuts"] + F.coalesce(changed, F.lit(False)).cast("int")).alias("cuts"))

        end = F.aggregate(F.sequence(F.lit(1), rounds), F.struct(texts.alias("texts"), F.lit(False).alias("stuck"), F.lit(0).alias("cuts")), one)
        return F.transform(F.array(end), lambda e: F.struct(F.transform(t["kept"], lambda m, i: F.struct(m["role"].alias("role"), F.element_at(e["texts"], i + 1).alias("content"))).alias("messages"), t["removed"].alias("removed"), e["cuts"].alias("shortened")))[0]

    return F.when(messages.isNotNull(), F.transform(F.transform(F.array(sizes), trimmed), shortened)[0])
