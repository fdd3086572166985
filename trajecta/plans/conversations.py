"""Message operators over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import candidates as CA
from trajecta.operators import messages as M
from trajecta.plans.base import plan, table

PLANS: dict = {}

#: One row for each conversation and turn with its place from 0 and the assistant turns up to it.
LONG = """select *, row_number() over (partition by conv_id order by turn) - 1 i, sum(cast(role = 'assistant' as int)) over (partition by conv_id order by turn) a,
count(*) over (partition by conv_id) n, sum(cast(role = 'assistant' as int)) over (partition by conv_id) na from conversations"""


def convs(s, d):
    return M.gather(table(s, d, "conversations"))


@plan(PLANS, f"with l as ({LONG}) select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) role_turn, round(i * 1.0 / greatest(n - 1, 1), 6) place from l")
def role_turn_counter(s, d):
    return M.role_counter(table(s, d, "conversations")).select("conv_id", "turn", "role", "role_turn", F.round("place", 6).alias("place"))


CUT = f"""with l as ({LONG}), c as (select conv_id, max(na) na from l group by 1), r as (select conv_id, na, unnest([0.1, 0.3, 0.5]) share from c),
t as (select *, case when na <= 1 then 0 else cast(ceil(share * (na - 1) - 1e-9) as int) end turn_cut from r)"""


@plan(PLANS, f"{CUT} select t.conv_id, cast(share as double) share, turn_cut, count(*) filter (na_ok and l.i <= p) n_prefix, count(*) filter (not (na_ok and l.i <= p)) n_rest from (select t.*, na > 0 na_ok, (select min(l.i) from l where l.conv_id = t.conv_id and l.a = t.turn_cut + 1) p from t) t join l on l.conv_id = t.conv_id group by 1, 2, 3")
def prefix_split_sizes(s, d):
    c = convs(s, d).withColumn("share", F.explode(F.array(F.lit(0.1), F.lit(0.3), F.lit(0.5))))
    n = M.count_role(F.col("messages"), "assistant")
    c = c.withColumn("turn_cut", F.coalesce(*[F.when(F.col("share") == x, M.cut_turn(n, x)) for x in (0.1, 0.3, 0.5)]))
    a, b = M.split_at(F.col("messages"), F.col("turn_cut"))
    return c.select("conv_id", "share", "turn_cut", F.size(a).cast("long").alias("n_prefix"), F.size(b).cast("long").alias("n_rest"))


@plan(PLANS, """with c as (select conv_id, max(case when turn = f then text end) t from (select *, min(case when role = 'user' then turn end) over (partition by conv_id) f from conversations) group by 1) select conv_id, t first_user, length(t) n_chars from c""")
def first_user_message(s, d):
    first = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(1))["content"]
    return convs(s, d).select("conv_id", first.alias("first_user"), F.length(first).cast("long").alias("n_chars"))


@plan(PLANS, f"with l as ({LONG}), c as (select conv_id, max(na) na, max(n) n from l group by 1), p as (select c.*, case when na <= 1 then 0 else cast(ceil(0.5 * (na - 1) - 1e-9) as int) end tc from c), q as (select p.*, (select min(l.i) from l where l.conv_id = p.conv_id and l.a = p.tc + 1) cutp from p) select q.conv_id, 1 + count(*) filter (q.na > 0 and l.i <= cutp) + least(count(*) filter (not (q.na > 0 and l.i <= coalesce(cutp, -1)) and role = 'user'), 1) n_messages from q join l on l.conv_id = q.conv_id group by 1")
def training_prompt_sizes(s, d):
    c = convs(s, d)
    a, b = M.split_at(F.col("messages"), M.cut_turn(M.count_role(F.col("messages"), "assistant"), 0.5))
    return c.select("conv_id", F.size(M.training_prompt(F.lit("You solve the task."), a, b)).cast("long").alias("n_messages"))


VAR = f"""with l as ({LONG}), c as (select conv_id, max(na) na from l group by 1), v as (select conv_id, na, 'fixed_0p3' variant, false is_raw, case when na <= 1 then 0 else cast(ceil(0.3 * (na - 1) - 1e-9) as int) end tc from c union all
select conv_id, na, 'fixed_0p5', false, case when na <= 1 then 0 else cast(ceil(0.5 * (na - 1) - 1e-9) as int) end from c union all select conv_id, na, 'raw', true, 0 from c),
p as (select v.*, (select min(l.i) from l where l.conv_id = v.conv_id and l.a = v.tc + 1) cutp, case when na > 1 then tc * 1.0 / (na - 1) else 0 end place from v),
k as (select p.conv_id, variant, is_raw, place, count(*) filter (l.role = 'assistant' and (is_raw or cutp is null or l.i > cutp)) ra, count(*) filter (l.role = 'user' and (is_raw or cutp is null or l.i > cutp)) ru from p join l on l.conv_id = p.conv_id group by 1, 2, 3, 4)"""


@plan(PLANS, f"{VAR} select conv_id, variant, case when is_raw then null else ra end remaining_turns, case when is_raw then null else greatest(ru - 1, 0) end remaining_steps, case when is_raw then 'raw' when place <= 1.0 / 3 then 'early' when place <= 2.0 / 3 then 'mid' else 'late' end cut_stage, not is_raw and ra = 0 and ru = 1 terminal_like, case when is_raw then 'raw' when ra = 0 and ru = 1 then 'prefix_terminal_like' else 'prefix_non_terminal' end row_type from k")
def row_labels(s, d):
    x = M.labels(M.variants(convs(s, d), "conv_id", [0.3, 0.5]))
    return x.select("conv_id", "variant", F.col("remaining_turns").cast("long").alias("remaining_turns"), F.col("remaining_steps").cast("long").alias("remaining_steps"), "cut_stage", "terminal_like", "row_type")


@plan(PLANS, f"{VAR}, z as (select case when is_raw then 'raw' when place <= 1.0 / 3 then 'early' when place <= 2.0 / 3 then 'mid' else 'late' end cut_stage, variant from k) select variant, cut_stage, count(*) n from z group by grouping sets ((variant), (cut_stage), (variant, cut_stage), ())")
def label_summary(s, d):
    x = M.labels(M.variants(convs(s, d), "conv_id", [0.3, 0.5]))
    v, c = F.col("variant"), F.col("cut_stage")
    return x.groupingSets([[v], [c], [v, c], []], v, c).agg(F.count("*").alias("n")).select("variant", "cut_stage", "n")


@plan(PLANS, f"{VAR} select 'main::' || cast(conv_id as varchar) || '::' || variant record_uid, is_raw from k")
def record_uids(s, d):
    x = M.variants(convs(s, d), "conv_id", [0.3, 0.5])
    return x.select(M.record_uid("main", F.col("conv_id").cast("string"), F.col("variant")).alias("record_uid"), M.is_raw(F.col("is_raw"), F.col("variant")).alias("is_raw"))


#: Assistant messages in four forms by their turn: right, without an action, with two, and with an empty one.
SAID = "select *, case when role <> 'assistant' then text when (conv_id + turn) % 11 = 0 then text when (conv_id + turn) % 11 = 1 then 'Action: a' || chr(10) || 'Action: b' when (conv_id + turn) % 11 = 2 then 'Action: !!' else 'Thought: t' || chr(10) || 'Action: get ' || turn end said from conversations"


def acting(s, d):
    k = (F.col("conv_id") + F.col("turn")) % 11
    said = F.when((F.col("role") != "assistant") | (k == 0), F.col("text")).when(k == 1, "Action: a\nAction: b").when(k == 2, "Action: !!").otherwise(F.concat(F.lit("Thought: t\nAction: get "), F.col("turn").cast("string")))
    return M.gather(table(s, d, "conversations").withColumn("text", said))


@plan(PLANS, f"with s as ({SAID}), k as (select conv_id, cast(count(*) filter (role = 'assistant' and (conv_id + turn) % 11 < 3) as bigint) n_invalid, count(*) filter (role = 'assistant' and (conv_id + turn) % 11 >= 3) n_right, string_agg(case (conv_id + turn) % 11 when 0 then 'missing_action_tag' when 1 then 'multiple_action_tags' else 'empty_sanitized_action' end, ',' order by turn) filter (role = 'assistant' and (conv_id + turn) % 11 < 3) reasons from s group by 1) select conv_id, n_invalid, coalesce(reasons, '') reasons, n_invalid > 0 or n_right = 0 dropped from k")
def invalid_prefix_turns(s, d):
    bad = M.invalid_turns(F.col("messages"))
    return acting(s, d).select("conv_id", F.size(bad).cast("long").alias("n_invalid"), F.array_join(F.transform(bad, lambda x: x["reason"]), ",").alias("reasons"), ((F.size(bad) > 0) | (F.size(M.actions(F.col("messages"))) == 0)).alias("dropped"))


@plan(PLANS, "with l as (select *, row_number() over (partition by conv_id order by turn) i from conversations), f as (select conv_id, max(case when i = 1 then text end) first from l where i = 1 group by 1) select l.conv_id, i - case when l.conv_id % 2 = 0 then 1 else 0 end - 1 place, role, text content, cast(role = 'assistant' as int) train from l join f on f.conv_id = l.conv_id where not (l.conv_id % 2 = 0 and i = 1)")
def behaviour_clone_rows(s, d):
    """Demonstrations of all conversations; in the even ones the prompt ends with their first message, which then isn't repeated."""
    c = convs(s, d)
    prompt = F.when(F.col("conv_id") % 2 == 0, F.slice("messages", 1, 1)).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    x = c.select("conv_id", F.posexplode(M.demo_messages(prompt, F.col("messages"))).alias("place", "m"))
    return x.select("conv_id", F.col("place").cast("long").alias("place"), "m.role", "m.content", "m.train")


@plan(PLANS, "with w as (select conv_id, turn, role, unnest(string_split(text, ' ')) w, generate_subscripts(string_split(text, ' '), 1) j from conversations), r as (select *, row_number() over (partition by conv_id order by turn, j) i from w) select conv_id, cast(sum(case when i <= 64 then length(w) else 0 end) as bigint) id_sum, cast(sum(cast(i <= 64 and role = 'assistant' as int)) as bigint) trained, 64 n from r group by 1")
def encoded_demonstrations(s, d):
    """Words as tokens (a word's length as its id), cut at 64 and filled up."""
    demo = M.demo_messages(F.array().cast("array<struct<role:string,content:string>>"), F.col("messages"))
    ids, mask = M.encoded_targets(demo, lambda m: F.transform(F.split(m["content"], " "), lambda w: F.length(w)), 0, 64)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return convs(s, d).select("conv_id", total(ids).alias("id_sum"), total(mask).alias("trained"), F.size(ids).alias("n"))


@plan(PLANS, "select conv_id, string_agg('<|' || role || '|>' || text, chr(10) order by turn) rendered from conversations group by 1")
def render_history(s, d):
    return convs(s, d).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"])), "\n").alias("rendered"))


@plan(PLANS, "with t as (select conv_id, turn, length(text) n, sum(length(text)) over (partition by conv_id order by turn) e from conversations) select conv_id, turn, cast(e - n as bigint) span_start, cast(e as bigint) span_end from t")
def message_spans(s, d):
    from pyspark.sql import Window

    n = F.length("text")
    e = F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(s, d, "conversations").select("conv_id", "turn", (e - n).alias("span_start"), e.alias("span_end"))


#: One conversation in three is raw; every fourth other one has its assistant messages right throughout.
_RIGHT = "conv_id % 4 = 1"
_FORM = f"case when {_RIGHT} then 7 else (conv_id + turn) % 11 end"


def prefixes(s, d):
    right, k = F.col("conv_id") % 4 == 1, (F.col("conv_id") + F.col("turn")) % 11
    good = F.concat(F.lit("Thought: t\nAction: get "), F.col("turn").cast("string"))
    said = F.when(F.col("role") != "assistant", F.col("text")).when(right, good).when(k == 0, F.col("text")).when(k == 1, "Action: a\nAction: b").when(k == 2, "Action: !!").otherwise(good)
    x = M.gather(table(s, d, "conversations").withColumn("text", said)).withColumnRenamed("messages", "prefix_messages")
    return x.withColumns({"prefix_actions": M.actions(F.col("prefix_messages")), "is_raw_variant": F.col("conv_id") % 3 == 0})


@plan(PLANS, f"""with f as (select *, {_FORM} form from conversations), k as (select conv_id, count(*) filter (role = 'assistant' and form < 3) bad, count(*) filter (role = 'assistant' and form >= 3) good,
string_agg(case form when 0 then 'missing_action_tag:0' when 1 then 'multiple_action_tags:2' else 'empty_sanitized_action:1' end, ',' order by turn) filter (role = 'assistant' and form < 3) why from f group by 1)
select conv_id, conv_id % 3 = 0 or bad = 0 and good > 0 kept, case when conv_id % 3 = 0 then '' when bad > 0 then why when good = 0 then 'no_runtime_actions_after_filter:0' else '' end why from k""")
def runtime_split(s, d):
    """Prefixes that can be replayed and those that can't, with the reason for each turn."""
    kept, dropped = CA.split_runtime_invalid(prefixes(s, d))
    why = F.array_join(F.transform("runtime_invalid_details", lambda x: F.concat(x["reason"], F.lit(":"), x["tags"])), ",")
    return kept.select("conv_id", F.lit(True).alias("kept"), F.lit("").alias("why")).union(dropped.select("conv_id", F.lit(False), why))


@plan(PLANS, f"""with f as (select *, {_FORM} form from conversations), k as (select conv_id, count(*) filter (role = 'assistant') turns, count(*) filter (role = 'assistant' and form = 0) missing, count(*) filter (role = 'assistant' and form = 1) several, count(*) filter (role = 'assistant' and form > 0) line from f group by 1)
select conv_id, turns, missing, several, line, 0 bracket, turns = missing empty_actions from k""")
def reparsed_candidates(s, d):
    """Loose actions of each prefix, with the histogram of how they were found."""
    x = prefixes(s, d).select("conv_id", CA.reparsed(F.col("prefix_messages")).alias("r"))
    mode = lambda m: F.coalesce(F.try_element_at("r.summary.modes", F.lit(m)), F.lit(0)).alias(m)
    return x.select("conv_id", "r.summary.turns", "r.summary.missing", "r.summary.several", mode("line"), mode("bracket"), F.col("r.summary.empty").alias("empty_actions"))


@plan(PLANS, "with t as (select conv_id, count(*) n from conversations group by 1), b as (select conv_id % 5 task_id, min(conv_id) least from conversations group by 1) select c.conv_id, turn, n teacher_n_messages, least base_least from conversations c join t using (conv_id) join b on b.task_id = c.conv_id % 5 where role = 'assistant'")
def matched_candidates(s, d):
    """Every assistant turn as a candidate, with its conversation's row and its task's row; both must be there."""
    c = table(s, d, "conversations").withColumn("task_id", F.col("conv_id") % 5)
    teachers = c.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    bases = c.groupBy("task_id").agg(F.min("conv_id").alias("least"))
    return CA.matched_candidates(c.where("role = 'assistant'"), teachers, bases, "conv_id", "task_id").select("conv_id", "turn", "teacher_n_messages", "base_least")


@plan(PLANS, """with m as (select conv_id % 7 sample_uid, avg(length(text) / 1000.0) raw_mean from conversations where turn % 2 = 0 and conv_id % 7 <> 2 group by 1), x as (select conv_id, turn, least(length(text) // 20, 40) + 1 n, length(text) / 400.0 reward, raw_mean from conversations c left join m on m.sample_uid = c.conv_id % 7 where turn % 2 = 1),
y as (select *, case when raw_mean is null then 'missing' when n > 32 then 'overlong' else 'kept' end state from x), k as (select count(*) filter (state = 'missing') missing, count(*) filter (state = 'overlong') overlong from y)
select conv_id, turn, round(greatest(least(reward - raw_mean, 1), 0), 6) advantage, round(greatest(least(reward - raw_mean, 1), 0) * 0.5 * (n - n // 2), 5) total, cast(n as int) attended, cast(32 - n as int) padded, round(reward, 6) score, missing, overlong from y, k where state = 'kept'""")
def demo_batches(s, d):
    """Odd turns as demonstrations over the mean of the even ones of their sample, padded to 32 places."""
    c = table(s, d, "conversations").withColumns({"sample_uid": F.col("conv_id") % 7, "is_raw_variant": F.col("turn") % 2 == 0, "variant_label": F.lit("x")})
    means = CA.raw_reward_means(c.where("sample_uid <> 2").withColumn("reward", F.length("text") / 1000))
    n = (F.least(F.floor(F.length("text") / 20), F.lit(40)) + 1).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    demos = c.where("turn % 2 = 1").select("conv_id", "turn", "sample_uid", at.alias("response_ids"), F.lit(None).cast("array<int>").alias("attention"), F.transform(at, lambda i: (i >= F.floor(n / 2)).cast("double")).alias("loss_mask"), F.transform(at, lambda i: -i.cast("double")).alias("old_log_probs"), (F.length("text") / 400).alias("reward"))
    kept, counts = CA.demo_batch(demos, means, 32, -5, 0.5)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    x = kept.select("conv_id", "turn", F.round("advantage", 6).alias("advantage"), F.round(total("advantages"), 5).alias("total"), F.aggregate("response_attention", F.lit(0), lambda a, v: a + v).alias("attended"), F.size(F.filter("responses", lambda v: v == -5)).alias("padded"), F.round(total("token_scores"), 6).alias("score"))
    return x.crossJoin(counts.select(F.col("missing_raw_baseline_rows").alias("missing"), F.col("overlong_rows").alias("overlong")))


@plan(PLANS, """with l as (select *, row_number() over (partition by conv_id order by turn) i from conversations where role in ('user', 'assistant')), f as (select conv_id from l where i = 1 and role = 'user')
select conv_id, conv_id || '::0' sample_uid, 'lamp ' || conv_id goal, count(*) + 1 n, string_agg(case when role = 'user' then 'u' when turn % 3 = 0 then 'Think: t' || chr(10) || 'Action: [[ get ' || turn || ' ]]' else l.text end, '|' order by turn) said from l join f using (conv_id) group by 1""")
def canonical_trajectories(s, d):
    """Whole conversations in one form, behind two warm-up messages."""
    t = F.col("turn")
    said = F.when(F.col("role") == "user", F.concat(F.lit("Goal: craft lamp "), F.col("conv_id"))).when(t % 3 == 0, F.concat(F.lit("Thought: t\nAction: get "), t)).otherwise(F.col("text"))
    c = M.gather(table(s, d, "conversations").withColumn("text", said))
    one = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    c = c.where(F.try_element_at(F.filter("messages", lambda m: m["role"].isin("user", "assistant")), F.lit(1))["role"] == "user")
    warm = c.select("conv_id", F.lit(0).alias("sample_idx"), F.concat(F.array(one("user", X.WARMUP_USER), one("assistant", X.WARMUP_ASSISTANT + " now")), "messages").alias("conversations"))
    x = CA.canonical_trajectory(warm, "system", item="conv_id")
    parts = F.transform("episode_messages", lambda m: F.when(m["role"] == "user", "u").otherwise(m["content"]))
    return x.select("conv_id", "sample_uid", "goal", F.size("canonical_messages").cast("long").alias("n"), F.array_join(parts, "|").alias("said"))
