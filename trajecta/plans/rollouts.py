"""Rollout groups: responses are ``orders``, grouped by customer and scored by price."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.operators import advantage, losses, metrics
from trajecta.plans.base import plan, table

PLANS: dict = {}

ROLL = "select o_custkey uid, o_orderkey rid, o_totalprice * 0.000731058578 score, cast(o_orderkey % 97 + 1 as double) len from orders"
WG = "over (partition by uid)"


def rollouts(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("rid"), (F.col("o_totalprice") * 0.000731058578).alias("score"), (F.col("o_orderkey") % 97 + 1).cast("double").alias("len"))


def _out(df):
    return df.select("uid", "rid", F.round("advantage", 4).alias("advantage"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round((score - case when count(*) {WG} > 1 then avg(score) {WG} else 0 end) / (case when count(*) {WG} > 1 then stddev_samp(score) {WG} else 1 end + 1e-6), 4) advantage from r")
def adv_grpo(s, d):
    return _out(advantage.get("grpo")(rollouts(s, d), group="uid", score="score"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round((score - case when count(*) {WG} > 1 then avg(score) {WG} else 0 end) / (case when count(*) {WG} > 1 then sqrt(greatest(var_samp(score) {WG}, 1e-6)) else 1 end + 1e-6), 4) advantage from r")
def adv_grpo_vectorized(s, d):
    return _out(advantage.get("grpo_vectorized")(rollouts(s, d), group="uid", score="score"))


@plan(PLANS, f"""with r as ({ROLL}), k as (select *, row_number() over (partition by uid order by score desc, rid) rn, count(*) {WG} n, stddev_samp(score) {WG} sd from r),
t as (select uid, max(score) s2 from k where rn = 2 group by uid)
select k.uid, rid, round(case when rn = 1 then (score - s2) / (sd + 1e-6) else 0 end, 4) advantage from k join t on k.uid = t.uid where n >= 2""")
def adv_grpo_passk(s, d):
    r = rollouts(s, d)
    many = r.groupBy("uid").agg(F.count("*").alias("n")).where("n >= 2").select("uid")
    return _out(advantage.get("grpo_passk")(r.join(many, "uid"), group="uid", score="score", order="rid"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round(case when count(*) {WG} > 1 then score - (sum(score) {WG} - score) / (count(*) {WG} - 1) else score end, 4) advantage from r")
def adv_rloo(s, d):
    return _out(advantage.get("rloo")(rollouts(s, d), group="uid", score="score"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round(case when count(*) {WG} > 1 then score - (sum(score) {WG} - score) / (count(*) {WG} - 1) else 0 end, 4) advantage from r")
def adv_rloo_vectorized(s, d):
    return _out(advantage.get("rloo_vectorized")(rollouts(s, d), group="uid", score="score"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round(case when count(*) {WG} > 1 then score - sum(len * score) {WG} / sum(len) {WG} else score end, 4) advantage from r")
def adv_opo(s, d):
    return _out(advantage.get("opo")(rollouts(s, d), group="uid", score="score", length="len"))


WHITE = "t as (select sum(len) n, sum(len * x) s, sum(len * x * x) q from a) select uid, rid, round((x - s / n) / sqrt((q - s * s / n) / (n - 1) + 1e-8), 4) advantage from a, t"


@plan(PLANS, f"with r as ({ROLL}), a as (select uid, rid, len, score - case when count(*) {WG} > 1 then avg(score) {WG} else 0 end x from r), {WHITE}")
def adv_reinforce_pp_baseline(s, d):
    return _out(advantage.get("reinforce_plus_plus_baseline")(rollouts(s, d), group="uid", score="score", length="len"))


@plan(PLANS, f"with r as ({ROLL}), a as (select uid, rid, len, score x from r), {WHITE}")
def adv_reinforce_pp(s, d):
    return _out(advantage.get("reinforce_plus_plus")(rollouts(s, d), score="score", length="len"))


@plan(PLANS, f"with r as ({ROLL}) select uid, rid, round(score - min(score) {WG}, 4) advantage from r")
def adv_remax(s, d):
    r = rollouts(s, d)
    greedy = r.groupBy("uid").agg(F.min("score").alias("greedy"))
    return _out(advantage.get("remax")(r.join(greedy, "uid"), score="score", baseline="greedy"))


@plan(PLANS, f"with r as (select uid, rid, case when score < 73 then 0 else score end score from ({ROLL})), t as (select count(*) * 1.0 / greatest(count(*) filter (score <> 0), 1) al from r) select uid, rid, round(al * (score - case when count(*) {WG} > 1 then avg(score) {WG} else 0 end), 4) advantage from r, t")
def adv_gpg(s, d):
    r = rollouts(s, d).withColumn("score", F.when(F.col("score") < 73, 0.0).otherwise(F.col("score")))
    return _out(advantage.get("gpg")(r, group="uid", score="score"))


@plan(PLANS, "with v as (select user_id, event_type, avg(value) variant_mean from events group by 1, 2), b as (select user_id, max(case when event_type = 'view' then variant_mean end) b from v group by 1) select v.user_id, event_type, round(variant_mean * 0.731058578, 4) variant_mean, round(coalesce(greatest(least(variant_mean - b, 5.0), -5.0), 0) * 0.731058578, 4) lift, b is not null covered from v join b on v.user_id = b.user_id")
def family_lift(s, d):
    x = advantage.family_lift(table(s, d, "events"), "user_id", "event_type", "value", raw="view", clip=5.0)
    return x.select("user_id", "event_type", F.round(F.col("variant_mean") * 0.731058578, 4).alias("variant_mean"), F.round(F.col("lift") * 0.731058578, 4).alias("lift"), "covered")


#: Tokens of ``lineitem``: sequence is the order, place the line, log-probabilities from discount and tax.
TOK = "select l_orderkey seq, l_linenumber pos, -(l_discount * 10 + 0.1) lp, -(l_tax * 10 + 0.1) op, (l_quantity - 25) / 25 adv, case when l_returnflag = 'R' then 0 else 1 end mask from lineitem"


def tokens(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), (-(F.col("l_discount") * 10 + 0.1)).alias("lp"), (-(F.col("l_tax") * 10 + 0.1)).alias("op"), ((F.col("l_quantity") - 25) / 25).alias("adv"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"))


#: Weights of a rollout correction for the same tokens.
WTOK = TOK.replace(" from lineitem", ", 0.5 + l_linenumber / 4.0 w from lineitem")


def weighted_tokens(spark, d):
    return tokens(spark, d).withColumn("w", 0.5 + F.col("pos") / 4.0)


PPO = "select *, greatest(-adv * exp(lp - op), -adv * greatest(least(exp(lp - op), 1.2), 0.8)) u, -adv * exp(lp - op) p, -adv * greatest(least(exp(lp - op), 1.2), 0.8) c from t"


@plan(PLANS, f"with t as ({WTOK}), x as ({PPO}) select seq, pos, round(w * case when adv < 0 then least(u, -adv * 3) else u end, 4) + 0.0 loss, cast(c > p and mask = 1 as int) clipped, cast(u > -adv * 3 and adv < 0 and mask = 1 as int) clipped_low from x")
def loss_vanilla(s, d):
    return losses.LOSSES["vanilla"](weighted_tokens(s, d), "lp", "op", "adv", mask="mask", weight="w").select("seq", "pos", F.round("loss", 4).alias("loss"), "clipped", "clipped_low")


@plan(PLANS, f"with t as ({WTOK}), x as ({PPO}) select round(avg(cast(c > p as double)) filter (mask = 1), 6) clip_share, round(avg(cast(u > -adv * 3 and adv < 0 as double)) filter (mask = 1), 6) clip_share_low, round(avg(op - lp) filter (mask = 1), 6) ppo_kl from x")
def loss_clip_metrics(s, d):
    m = losses.loss_metrics(losses.LOSSES["vanilla"](weighted_tokens(s, d), "lp", "op", "adv", mask="mask"), "lp", "op", "mask")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@plan(PLANS, f"with t as ({WTOK}), r as (select *, exp(least(coalesce(avg(lp - op) filter (mask = 1) over (partition by seq), 0), 10)) q from t) select seq, pos, round(w * greatest(-adv * q, -adv * greatest(least(q, 1.0004), 0.9997)), 4) + 0.0 loss from r")
def loss_gspo(s, d):
    return losses.LOSSES["gspo"](weighted_tokens(s, d), "lp", "op", "adv", mask="mask", weight="w").select("seq", "pos", F.round("loss", 4).alias("loss"))


@plan(PLANS, f"with t as ({WTOK}) select seq, pos, round(-lp * adv * w, 4) + 0.0 loss from t")
def loss_gpg(s, d):
    return losses.LOSSES["gpg"](weighted_tokens(s, d), "lp", None, "adv", mask="mask", weight="w").select("seq", "pos", F.round("loss", 4).alias("loss"))


@plan(PLANS, f"with t as ({WTOK}), g as (select seq, sum(mask) + 1e-8 n, coalesce(sum(adv) filter (mask = 1), 0) a, coalesce(sum(sign(adv) * least(sign(adv) * (lp - op), sign(adv) * greatest(least(lp - op, 0.4), -0.4))) filter (mask = 1), 0) r, coalesce(sum(ln(w + 1e-10)) filter (mask = 1), 0) lw from t group by seq) select seq, round(-a / n * exp(r / n) * exp(lw / n), 4) + 0.0 loss from g")
def loss_geo_mean(s, d):
    return losses.LOSSES["geo_mean"](weighted_tokens(s, d), "lp", "op", "adv", mask="mask", weight="w").select("seq", F.round("loss", 4).alias("loss"))


COV = "m as (select avg(adv) ma, avg(lp) ml, count(*) n from t where mask = 1), c as (select t.*, n, (adv - ma) * (lp - ml) cov from t, m)"


@plan(PLANS, f"with t as ({WTOK}), {COV}, k as (select *, cast(mask = 1 and row_number() over (partition by mask order by round(cov, 9) desc, seq, pos) <= greatest(floor(n * 0.002), 1) as int) picked from c) select seq, pos, picked, round(w * (-adv * exp(lp - op) + picked * abs(lp - op)), 4) + 0.0 loss from k")
def loss_kl_cov(s, d):
    x = losses.LOSSES["kl_cov"](weighted_tokens(s, d), "lp", "op", "adv", share=0.002, mask="mask", weight="w")
    return x.select("seq", "pos", "picked", F.round("loss", 4).alias("loss"))


@plan(PLANS, f"with t as ({WTOK}), {COV}, x as (select *, -adv * exp(lp - op) p, -adv * greatest(least(exp(lp - op), 1.2), 0.8) b from c), f as (select *, mask = 1 and not b > p and cov > 0.1 and cov < 5 inside from x), k as (select *, cast(inside and row_number() over (partition by inside order by md5(seq || ':' || pos), seq, pos, adv, lp) <= greatest(floor(n * 0.01), 1) as int) picked from f) select seq, pos, picked, round(w * greatest(p, b) * (1 - picked), 4) + 0.0 loss from k")
def loss_clip_cov(s, d):
    x = losses.LOSSES["clip_cov"](weighted_tokens(s, d), "lp", "op", "adv", low=0.1, share=0.01, mask="mask", weight="w")
    return x.select("seq", "pos", "picked", (F.round("loss", 4) + 0.0).alias("loss"))


@plan(PLANS, f"with t as ({TOK}), g as (select seq, exp(avg(lp - op) filter (mask = 1)) q, min(lp - op) filter (mask = 1) l from t group by seq) select t.seq, pos, case when mask = 1 then round(least(exp(lp - op), 2), 5) else 0 end weight, cast(mask = 1 and q >= 0.5 and q <= 2 and l >= ln(0.5) as int) keep from t join g on g.seq = t.seq")
def rollout_correction(s, d):
    return losses.corrected(tokens(s, d), "lp", "op", "seq", "mask", veto=0.5).select("seq", "pos", F.round("weight", 5).alias("weight"), "keep")


@plan(PLANS, f"with r as (select *, score > 110 ok, -score / 100 lp from ({ROLL})) select uid, count(*) filter (ok) n_right, count(*) n, round(sum(case when not ok then exp(lp / 10) * lp end) / (sum(case when not ok then exp(lp / 10) end) + 1e-8) - sum(case when ok then exp((1 - len) / 5000) * lp end) / sum(case when ok then exp((1 - len) / 5000) end), 4) loss from r group by uid having count(*) filter (ok) > 0 and count(*) filter (ok) < count(*)")
def loss_drpo(s, d):
    r = rollouts(s, d).withColumns({"ok": F.when(F.col("score") > 110, 1.0).otherwise(0.0), "lp": -F.col("score") / 100})
    return losses.LOSSES["drpo"](r, "uid", "ok", "lp", "len").withColumn("loss", F.round("loss", 4))


AGG = f"with t as ({TOK}), p as (select seq, sum(case when mask <> 0 then adv * mask end) s, sum(mask) n from t group by seq) "


@plan(PLANS, AGG + "select 'token-mean' mode_name, round(sum(s) / sum(n), 6) loss from p union all select 'seq-mean-token-sum', round(avg(s), 6) from p where n > 0 union all select 'seq-mean-token-mean', round(avg(s / n), 6) from p where n > 0 union all select 'seq-mean-token-sum-norm', round(sum(s) / 7, 6) from p where n > 0")
def loss_aggregation(s, d):
    t = tokens(s, d)
    return metrics.union_by_name(*[losses.aggregate(t, "adv", "seq", "mask", m, 7).select(F.lit(m).alias("mode_name"), F.round("loss", 6).alias("loss")) for m in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")])


@plan(PLANS, f"with t as ({TOK}), x as (select *, greatest(least(lp, op + 0.2), op - 0.2) c from t) select seq, pos, round(0.5 * greatest(pow(lp - adv, 2), pow(c - adv, 2)), 4) loss, cast(pow(c - adv, 2) > pow(lp - adv, 2) as int) clipped from x")
def loss_value_clip(s, d):
    return losses.value_loss(tokens(s, d), "lp", "op", "adv", 0.2).select("seq", "pos", F.round("loss", 4).alias("loss"), "clipped")


@plan(PLANS, f"with t as ({TOK}) select seq, pos, round(lp - op, 6) + 0.0 k1, round(abs(lp - op), 6) k_abs, round(0.5 * (lp - op) * (lp - op), 6) k2, round(greatest(least(exp(op - lp) - (op - lp) - 1, 10), -10), 6) k3 from t")
def kl_estimators(s, d):
    from trajecta.functions.arrays import kl

    a, b = F.col("lp"), F.col("op")
    return tokens(s, d).select("seq", "pos", F.round(kl(a, b, "k1"), 6).alias("k1"), F.round(kl(a, b, "abs"), 6).alias("k_abs"), F.round(kl(a, b, "k2"), 6).alias("k2"), F.round(kl(a, b, "k3"), 6).alias("k3"))


@plan(PLANS, f"with t as ({TOK}) select seq, pos, round(adv - 0.05 * (lp - op) * mask, 6) + 0.0 reward from t")
def kl_penalised_reward(s, d):
    from trajecta.functions.arrays import kl

    return tokens(s, d).select("seq", "pos", F.round(F.col("adv") - 0.05 * kl(F.col("lp"), F.col("op"), "kl") * F.col("mask"), 6).alias("reward"))


@plan(PLANS, f"with t as ({TOK}) select seq, pos, round(least(exp(lp - op), 2), 5) w_token, round(least(exp(sum(lp - op) over (partition by seq)), 2), 5) w_seq, round(least(exp(avg(lp - op) over (partition by seq)), 2), 5) w_geo from t")
def importance_weights(s, d):
    t = tokens(s, d)
    x = losses.importance_weights(t, "lp", "op", "seq", "token").withColumnRenamed("weight", "w1")
    x = losses.importance_weights(x, "lp", "op", "seq", "sequence").withColumnRenamed("weight", "w2")
    x = losses.importance_weights(x, "lp", "op", "seq", "geometric").withColumnRenamed("weight", "w3")
    return x.select("seq", "pos", F.round("w1", 5).alias("w_token"), F.round("w2", 5).alias("w_seq"), F.round("w3", 5).alias("w_geo"))


@plan(PLANS, f"with t as ({TOK}), r as (select seq, exp(avg(lp - op)) q, min(lp - op) l from t group by seq) select seq, round(q, 5) ratio, q >= 0.5 and q <= 2 in_bounds, l < ln(0.5) vetoed from r")
def rejection_mask(s, d):
    return losses.rejection(tokens(s, d), "lp", "op", "seq", 0.5, 2.0, 0.5).withColumn("ratio", F.round("ratio", 5))


@plan(PLANS, f"with t as ({TOK}), w as (select exp(lp - op) w from t) select round(avg(w), 5) mean, round(max(w), 5) max, round(min(w), 5) min, round(stddev_samp(w), 5) std, round(avg(cast(w > 2 as double)), 5) share_high, round(avg(cast(w < 0.5 as double)), 5) share_low, round(pow(avg(w) + 1e-8, 2) / avg(w * w), 5) ess from w")
def importance_metrics(s, d):
    m = losses.weight_metrics(tokens(s, d).withColumn("w", losses.ratio(F.col("lp"), F.col("op"))), "w", 0.5, 2.0)
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@plan(PLANS, f"with t as ({TOK}), p as (select seq, avg(lp) n, avg(op) o, avg(op - lp) kl, avg(exp(lp - op) - (lp - op) - 1) k3, avg(exp(2 * (lp - op))) x2 from t group by seq) select round(avg(exp(-n)), 5) ppl, round(avg(exp(-o)), 5) rollout_ppl, round(avg(kl), 5) kl, round(avg(k3), 5) k3_kl, round(avg(o - n), 5) log_ppl_diff, round(max(abs(o - n)), 5) log_ppl_abs_diff_max, round(avg(exp(o - n)), 5) ppl_ratio, round(avg(x2) - 1, 5) chi2_token from p")
def off_policy_diagnostics(s, d):
    m = losses.off_policy(tokens(s, d), "lp", "op", "seq")
    return m.select(*[F.round(c, 5).alias(c) for c in m.columns])


@plan(PLANS, f"with t as ({TOK}) select round(corr(exp(lp), exp(op)), 5) pearson, round(max(abs(exp(lp) - exp(op))), 5) diff_max, round(avg(abs(exp(lp) - exp(op))), 5) diff_mean, round(stddev_samp(abs(exp(lp) - exp(op))), 5) diff_std from t where mask = 1")
def probability_correlation(s, d):
    t = tokens(s, d).where("mask = 1").select(F.exp("lp").alias("a"), F.exp("op").alias("b"))
    e = F.abs(F.col("a") - F.col("b"))
    return t.agg(F.round(F.corr("a", "b"), 5).alias("pearson"), F.round(F.max(e), 5).alias("diff_max"), F.round(F.avg(e), 5).alias("diff_mean"), F.round(F.stddev_samp(e), 5).alias("diff_std"))


@plan(PLANS, f"with t as ({TOK}), m as (select sum(mask) n, sum(adv * mask) s, sum(adv * adv * mask) q from t) select round(s, 3) masked_sum, round(s / (n + 1e-8), 6) masked_mean, round((q - s * s / n) / (n - 1), 6) masked_var from m")
def masked_statistics(s, d):
    m = metrics.masked(tokens(s, d), "adv", "mask")
    return m.select(F.round("masked_sum", 3).alias("masked_sum"), F.round("masked_mean", 6).alias("masked_mean"), F.round("masked_var", 6).alias("masked_var"))


@plan(PLANS, f"with r as ({ROLL}) select uid, count(*) n, round(case when count(*) > 1 then avg(score) else 0 end, 4) mean, round(case when count(*) > 1 then sqrt(greatest(var_samp(score), 1e-6)) else 1 end, 4) std from r group by uid")
def group_mean_std(s, d):
    return metrics.group_stats(rollouts(s, d), "uid", "score").select("uid", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@plan(PLANS, f"with r as (select uid, case when score > 180 then score else 0 end score from ({ROLL})), g as (select uid, count(*) n, count(*) filter (score > 0) p, sum(score) s, bool_and(score = 0) z from r group by uid) select round(avg(cast(z as double)), 5) all_zero_rate, round(avg(cast(p > 0 as double)), 5) any_positive_rate, round(avg(p), 5) positives_mean, max(p) positives_max, round(avg(s), 3) reward_sum_mean, round(avg(n), 5) size_mean, min(n) size_min, max(n) size_max from g")
def group_reward_metrics(s, d):
    m = metrics.group_rewards(rollouts(s, d).withColumn("score", F.when(F.col("score") > 180, F.col("score")).otherwise(0.0)), "uid", "score")
    return m.select(*[F.round(c, 3 if c == "reward_sum_mean" else 5).alias(c) if "mean" in c or "rate" in c else F.col(c) for c in m.columns])


@plan(PLANS, f"with r as ({ROLL}) select round(avg(score), 4) score_mean, round(max(score), 4) score_max, round(min(score), 4) score_min, round(avg(len), 4) len_mean, max(len) len_max, min(len) len_min, round(avg(cast(len >= 97 as double)), 5) clip_ratio, round(avg(cast(len = 0 as double)), 5) aborted_ratio, round(1 - var_samp(score - len) / (var_samp(score) + 1e-5), 5) explained_var from r")
def batch_data_metrics(s, d):
    m = metrics.data_metrics(rollouts(s, d), "score", "len", 97, "len", "score")
    return m.select(*[F.col(c) if c in ("len_max", "len_min") else F.round(c, 5 if "ratio" in c or "var" in c else 4).alias(c) for c in m.columns])


@plan(PLANS, "with g as (select user_id, count(*) n, count(*) filter (event_type = 'purchase') c from events group by 1) select user_id, n, c, round(case when n < 1 then null when c = 0 then 0 when n - c < 1 then 1 else 1 - (n - c) * 1.0 / n end, 6) pass_at_1, round(case when n < 2 then null when c = 0 then 0 when n - c < 2 then 1 else 1 - (n - c) * 1.0 / n * (n - c - 1) / (n - 1) end, 6) pass_at_2, round(case when n < 4 then null when c = 0 then 0 when n - c < 4 then 1 else 1 - (n - c) * 1.0 / n * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2) * (n - c - 3) / (n - 3) end, 6) pass_at_4 from g")
def pass_at_k(s, d):
    m = metrics.pass_at_k(table(s, d, "events").withColumn("ok", F.col("event_type") == "purchase"), "user_id", "ok", [1, 2, 4])
    return m.select("user_id", "n", "c", *[F.round(f"pass_at_{k}", 6).alias(f"pass_at_{k}") for k in (1, 2, 4)])


@plan(PLANS, "with v as (select user_id, event_type, count(*) votes, min(event_id) f from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by votes desc, f) k from v) select r.user_id, r.event_type vote, round(e.value, 4) \"value\", votes from r join events e on e.event_id = r.f where k = 1")
def majority_vote(s, d):
    m = metrics.majority(table(s, d, "events"), "user_id", "event_type", "value", "event_id")
    return m.select("user_id", "vote", F.round("value", 4).alias("value"), "votes")


@plan(PLANS, "with p as (select event_type, user_id, avg(value) m, stddev_pop(value) s, max(value) b, min(value) w, count(*) n from events group by 1, 2) select event_type, round(avg(m), 4) mean, round(avg(s), 4) std, round(avg(b), 4) best, round(avg(w), 4) worst, max(n) n_max, count(*) n_uid from p group by 1")
def validation_rollup(s, d):
    m = metrics.validation(table(s, d, "events"), "event_type", "user_id", "value")
    return m.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "std", "best", "worst")], "n_max", "n_uid")


@plan(PLANS)
def bootstrap_best_worst(s, d):
    return metrics.bootstrap(table(s, d, "events"), "event_type", "value", "event_id", 8)


@plan(PLANS, "select o_orderstatus, o_orderpriority, count(*) n, count(*) filter (o_orderkey % 11 = 0) errors, round(avg(case when o_orderkey % 11 <> 0 then o_totalprice end), 3) avg_reward, round(avg(case when o_orderkey % 11 <> 0 then cast(o_totalprice > 200000 as double) end), 6) success_rate from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def eval_summary(s, d):
    o = table(s, d, "orders").withColumns({"err": F.when(F.col("o_orderkey") % 11 == 0, "timeout"), "ok": F.col("o_totalprice") > 200000})
    m = metrics.eval_summary(o, ["o_orderstatus", "o_orderpriority"], "o_totalprice", "ok", "err")
    return m.select("o_orderstatus", "o_orderpriority", "n", "errors", F.round("avg_reward", 3).alias("avg_reward"), F.round("success_rate", 6).alias("success_rate"))


@plan(PLANS, "with m as (select event_type || case when user_id % 3 = 0 then '_max' when user_id % 3 = 1 then '_min' else '' end k, value v from events) select k \"key\", round(case when contains(k, 'max') then max(v) when contains(k, 'min') then min(v) else avg(v) end, 4) \"value\" from m group by k")
def reduce_by_name(s, d):
    e = table(s, d, "events").select(F.concat("event_type", F.when(F.col("user_id") % 3 == 0, "_max").when(F.col("user_id") % 3 == 1, "_min").otherwise("")).alias("key"), "value")
    return metrics.by_name(e).select("key", F.round("value", 4).alias("value"))


@plan(PLANS, f"with r as ({ROLL}) select cast(sum(len) as bigint) total_tokens, round(sum(score), 2) \"time\", round(sum(len) / (sum(score) * 4), 8) throughput, round(sum(score) * 1000 / sum(len), 4) ms_per_token from r")
def throughput_metrics(s, d):
    m = metrics.throughput(rollouts(s, d), "len", "score", 4)
    return m.select(F.col("total_tokens").cast("long").alias("total_tokens"), F.round("time", 2).alias("time"), F.round("throughput", 8).alias("throughput"), F.round("ms_per_token", 4).alias("ms_per_token"))


@plan(PLANS, "select round(min(l_quantity), 4) gen_min, round(max(l_quantity), 4) gen_max, round(avg(l_quantity), 4) gen_mean, round(min(l_tax), 4) tool_min, round(max(l_tax), 4) tool_max, round(avg(l_tax), 4) tool_mean, (select l_orderkey from lineitem order by l_quantity + l_tax desc, l_orderkey, l_linenumber limit 1) slowest_l_orderkey from lineitem")
def agent_loop_timings(s, d):
    m = metrics.slowest(table(s, d, "lineitem"), "l_quantity", "l_tax", ["l_orderkey"])
    return m.select(*[F.col(c) if c.startswith("slow") else F.round(c, 4).alias(c) for c in m.columns])
