"""Graders and prefix operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from trajecta.functions import algebra as AL
from trajecta.functions import scoring as S
from trajecta.operators import graph as G
from trajecta.operators import messages as M
from trajecta.operators import prefixes as P
from trajecta.operators.batch import spread
from trajecta.plans.base import plan, shipped, table
from trajecta.plans.rollouts import TOK, tokens

PLANS: dict = {}


@plan(PLANS, "select p_partkey k, case p_partkey % 4 when 0 then 1.0 when 1 then 0.25 when 2 then 0.1 else 0.0 end exact, case p_partkey % 4 when 0 then 1.0 when 1 then 1.0 when 2 then 0.0 else 0.0 end \"contains\" from part")
def qa_match_scores(s, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    t = F.when(k == 0, F.concat(F.lit("so <answer> The "), n, F.lit("! </answer>"))).when(k == 1, F.concat(F.repeat(F.lit("<answer>x</answer>"), F.lit(11)), F.lit("<answer>"), n, F.lit("</answer>"))).when(k == 2, F.lit("<answer>zzz</answer>")).otherwise(n)
    g = F.array(F.lit("other"), n)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), S.match_score(t, g, other=0.1).alias("exact"), S.match_score(t, g, contains=True).alias("contains"))


@plan(PLANS, "select o_orderkey k, case when o_orderkey % 2 = 0 then 1.0 else 0.0 end strict, 1.0 loose from orders")
def number_scores(s, d):
    k = F.col("o_orderkey")
    t = F.concat(F.when(k % 2 == 0, F.lit("#### ")).otherwise(F.lit("answer: ")), k.cast("string"))
    return table(s, d, "orders").select(k.alias("k"), S.number_score(t, k.cast("string")).alias("strict"), S.number_score(t, k.cast("string"), strict=False).alias("loose"))


@plan(PLANS, "select o_orderkey k, round(least(-((o_orderkey % 97) - (90 - 30)) / 30.0 * 0.5, 0) + 0.0, 6) penalty from orders")
def overlong_penalty(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.round(S.overlong_penalty(F.col("o_orderkey") % 97, 90, 30, 0.5), 6).alias("penalty"))


@plan(PLANS, "select event_id, case event_type when 'view' then cast(value > 50 as int) * 1.0 when 'click' then case when event_id % 2 = 0 then 1.0 else 0.1 end else round(value, 4) + event_id % 7 end score from events")
def score_dispatch(s, d):
    turns = F.array(F.round("value", 4), (F.col("event_id") % 7).cast("double"))
    answer = F.concat(F.lit("<answer>"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit("x")), F.lit("</answer>"))
    rules = {"view": (F.col("value") > 50).cast("double"), "click": S.match_score(answer, F.array("event_type"), other=0.1)}
    return table(s, d, "events").select("event_id", S.dispatch(F.col("event_type"), rules, turns).alias("score"))


@plan(PLANS, r"select o_orderkey k, case o_orderkey % 4 when 3 then null when 1 then '\frac{' || o_orderkey || '}{2}' else cast(o_orderkey as varchar) end boxed, case when o_orderkey % 4 < 2 then 1.0 else 0.0 end score from orders")
def boxed_answers(s, d):
    """Right, right as a fraction written otherwise, wrong and missing answers."""
    boxed, score = S.math_columns()
    n, k = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    half = lambda name: F.concat(F.lit(f"\\{name}{{"), k, F.lit("}{2}"))
    t = F.when(n % 4 == 3, F.concat(F.lit("no box: "), k)).otherwise(F.concat(F.lit("first \\boxed{1} then $\\boxed{"), F.when(n % 4 == 1, half("frac")).otherwise(k), F.lit("}$ done")))
    truth = F.when(n % 4 == 1, half("dfrac")).when(n % 4 == 2, (n + 1).cast("string")).otherwise(F.concat(k, F.lit("\\text{ cm}")))
    return shipped(s, d, "orders").select(n.alias("k"), boxed(t).alias("boxed"), score(t, truth).alias("score"))


@plan(PLANS, "with m as (select max(o_totalprice) hi, min(o_totalprice) lo from orders) select o_orderkey, round(pow(o_totalprice / 100000, 2), 6) w_pow, case when o_totalprice in (hi, lo) then 1.0 else 0.0 end w_max_min, case when o_totalprice = hi then 0.4 else 0.1 end w_max_random from orders, m")
def filter_weights(s, d):
    o = table(s, d, "orders")
    x = o.join(F.broadcast(o.agg(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"))))  # one row
    p = F.col("o_totalprice")
    return x.select("o_orderkey", F.round(S.filter_weights(p / 100000, "pow"), 6).alias("w_pow"), S.filter_weights(p, "max_min", most=F.col("hi"), least=F.col("lo")).alias("w_max_min"), S.filter_weights(p, "max_random", most=F.col("hi")).alias("w_max_random"))


@plan(PLANS, f"with t as ({TOK}), m as (select seq, sum(adv * mask) / greatest(sum(mask), 1) m, max(adv) r from t group by 1), l as (select *, greatest(least(r - 0.5, 0.3), -0.3) lift from m) select seq, round(m, 5) + 0.0 cont_mean, round(abs(m), 5) cont_mean_abs, round(greatest(m, 0), 5) + 0.0 cont_mean_pos, 0.7 \"constant\", case when r > 0 then 0.7 else 0.0 end success_gate_constant, round(lift, 5) + 0.0 family_lift, round(greatest(lift, 0), 5) family_lift_pos, round(abs(m) + lift, 5) + 0.0 cont_abs_plus_family_lift, round(abs(m) + greatest(lift, 0), 5) cont_abs_plus_family_lift_pos from l")
def sequence_advantages(s, d):
    t = tokens(s, d).groupBy("seq").agg((F.sum(F.col("adv") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("m"), F.max("adv").alias("r"))
    make = lambda mode: P.sequence_advantage(F.col("m"), mode, 0.7, F.col("r"), F.col("r") - 0.5, clip=0.3)
    return t.select("seq", *[make(m).alias(m) if "constant" in m else F.round(make(m), 5).alias(m) for m in P.MODES])


@plan(PLANS, "with q as (select l_orderkey k, list(l_tax order by l_linenumber, l_tax) lp, count(*) n from lineitem group by 1) select k, case when n >= 4 then lp[1:3] else []::double[] end prefix_log_probs, case when n >= 4 then [1, 0, 1] else []::int[] end prefix_mask, case when n >= 4 then 1 else 0 end span_start, case when n >= 4 then 4 else 0 end span_end, case when n >= 4 then 2 else 0 end prefix_tokens from q")
def prefix_windows(s, d):
    x = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_tax"))), lambda v: v["l_tax"]).alias("lp"))
    sp = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    spans = F.when(F.size("lp") >= 4, F.array(sp(1, 2), sp(3, 4))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    x = x.withColumn("spans", spans).withColumns(P.prefix_window(F.col("lp"), F.col("spans")))
    return x.select("k", "prefix_log_probs", "prefix_mask", F.col("prefix_span.start").alias("span_start"), F.col("prefix_span.end").alias("span_end"), "prefix_tokens")


@plan(PLANS, f"with t as ({TOK}) select round(avg(case when pos <= 2 then lp - op end), 6) delta_mean, round(avg(case when pos <= 2 then abs(lp - op) end), 6) delta_abs, round(avg(case when pos <= 2 then exp(lp - op) end), 6) ratio_mean, round(avg(cast(pos <= 2 as double)), 6) token_share, round(abs(sum(case when pos <= 2 then adv end)) / (abs(sum(case when pos <= 2 then adv end)) + abs(sum(case when pos > 2 then adv end)) + 1e-12), 6) loss_share from t")
def prefix_diagnostics(s, d):
    m = P.diagnostics(tokens(s, d).withColumn("p", F.col("pos") <= 2), "lp", "op", "p", "adv")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@plan(PLANS, "select l_orderkey, l_linenumber, sha256(l_returnflag || l_linestatus) code from lineitem where l_returnflag is not null")
def compute_once_join_back(s, d):
    x = table(s, d, "lineitem")
    done = P.once_for_each(x, [F.col("l_returnflag"), F.col("l_linestatus")], lambda u: u.select("__tj_key", F.sha2(F.concat("l_returnflag", "l_linestatus"), 256).alias("code")))
    return done.select("l_orderkey", "l_linenumber", "code")


@plan(PLANS, "with t as (select conv_id, turn, role, text, max(turn) over (partition by conv_id) last, count(*) over (partition by conv_id) n from conversations) select conv_id, place, kind, case kind when 'chosen' then text else reverse(text) end answer, n n_messages from t, (select 0 place, 'chosen' kind union all select 1, 'rejected') where turn = last")
def preference_pairs(s, d):
    """The last message of each conversation as the chosen answer, the same backwards as the rejected one."""
    c = M.gather(table(s, d, "conversations"))
    last = F.element_at("messages", -1)
    p = M.preference(F.slice("messages", 1, F.size("messages") - 1), last, F.struct(last["role"].alias("role"), F.reverse(last["content"]).alias("content")))
    x = c.select("conv_id", F.posexplode(p).alias("place", "p"))
    return x.select("conv_id", "place", "p.kind", F.element_at("p.messages", -1)["content"].alias("answer"), F.size("p.messages").cast("long").alias("n_messages"))


@plan(PLANS, "with i as (select l_orderkey k, l_partkey, cast(sum(cast(l_quantity as bigint)) as bigint) n from lineitem group by 1, 2) select k, 'craft 4 o' || k || ' using ' || string_agg(n || ' p' || l_partkey, ', ' order by 'p' || l_partkey) recipe, 4 n, 'o' || k item, list(n || ' p' || l_partkey order by 'p' || l_partkey) parts from i group by 1")
def recipe_strings(s, d):
    i = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("recipe"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("item")).agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    out = i.select("recipe", F.concat(F.lit("o"), F.col("recipe").cast("string")).alias("output"), F.lit(4).alias("count")).distinct()
    x = G.recipe_text(out, i)
    got = G.parse_recipe(F.col("text"))
    return x.select(F.col("recipe").alias("k"), F.col("text").alias("recipe"), got["count"].alias("n"), got["item"].alias("item"), got["parts"].alias("parts"))


#: Answers that are right by identity, right by a value near enough, or wrong: (given, truth, right, right when strict).
ANSWERS = [
    ("(x+{k})(x-{k})", "x^2-{k}^2", 1, 1),
    ("(x+{k})^2", "x^2+{k}^2", 0, 0),
    ("\\sqrt{{{k}}}\\cdot\\sqrt{{{k}}}", "{k}", 1, 0),
    ("\\frac{{{k}a+a^2}}{{a}}", "{k}+a", 1, 1),
    ("{k}\\pi", "{k}*3.14", 1, 0),
    ("2^{{x+1}}+{k}", "{k}+2\\cdot2^x", 1, 1),
    ("({k}, \\frac{{1}}{{3}})", "({k}, 1/3)", 1, 1),
    ("[{k}, 2)", "({k}, 2)", 0, 0),
    ("\\frac{{2}}{{{k}+{k}}}", "\\frac{{1}}{{{k}}}", 1, 1),
    ("\\sin({k}+y)+y", "y+\\sin(y+{k})", 1, 1),
    ("{k}.0001%", "{k}", 1, 0),
    ("yes {k}", "no {k}", 0, 0),
]


@plan(PLANS, "select p_partkey k, case p_partkey % 12 " + " ".join(f"when {i} then {bool(r)}" for i, (_, _, r, _) in enumerate(ANSWERS)) + " end correct, case p_partkey % 12 " + " ".join(f"when {i} then {bool(r)}" for i, (*_, r) in enumerate(ANSWERS)) + " end strict from part")
def maths_grades(s, d):
    """Boxed answers in twelve forms against their truths, as the grader sees them."""
    k = F.col("p_partkey")

    def form(at: int):
        out = F.lit(None).cast("string")
        for i, row in enumerate(ANSWERS):
            out = F.when(k % 12 == i, F.concat(*(F.col("p_partkey") + 9999 if x == "KEY" else F.lit(x) for x in re.split("(KEY)", row[at].format(k="KEY")) if x))).otherwise(out)
        return out

    x = spread(shipped(s, d, "part"), "p_partkey").select(k.alias("k"), F.concat(F.lit("so \\boxed{"), form(0), F.lit("}.")).alias("given"), form(1).alias("truth"))
    return x.select("k", AL.grade_columns()[1]("given", "truth").alias("correct"), AL.grade_columns(True)[1]("given", "truth").alias("strict"))
