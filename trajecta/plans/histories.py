"""Canonical JSON, spans, trimmed histories, choices, part logs, table differences and keyed state over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajecta.functions import variants as V
from trajecta.operators import compare as C
from trajecta.operators import messages as M
from trajecta.operators import shop as SH
from trajecta.plans.base import parts_by_rows, plan, table
from trajecta.sources import tables as T
from trajecta.sources.partlog import PartLog
from trajecta.streaming import keyed as K

PLANS: dict = {}

#: Objects of known shape, keys in order: {key: SQL of its compact value}.
_PROPS = {
    "device": "'{\"os\":' || json_extract(props, '$.device.os') || ',\"ver\":' || json_extract(props, '$.device.ver') || '}'",
    "items": "'[' || array_to_string(list_transform(json_extract(props, '$.items[*]'), lambda x: '{\"qty\":' || json_extract(x, '$.qty') || ',\"sku\":' || json_extract(x, '$.sku') || '}'), ',') || ']'",
    "k": "json_extract(props, '$.k')::varchar",
    "tags": "json_extract(props, '$.tags')::varchar",
}


@plan(PLANS, "select click_id, case when json_valid(props) then '{' || array_to_string(list_filter([" + ", ".join(f"case when json_exists(props, '$.{k}') then '\"{k}\":' || case when json_type(props, '$.{k}') = 'NULL' then 'null' else {v} end end" for k, v in _PROPS.items()) + "], lambda x: x is not null), ',') || '}' else props end canonical from clicks")
def canonical_props(s, d):
    """Properties of all clicks with their keys in order, at any depth."""
    return table(s, d, "clicks").select("click_id", V.canonical_json(F.col("props")).alias("canonical"))


@plan(PLANS, "select l_orderkey, l_linenumber, case (l_partkey + l_linenumber) % 7 when 3 then '' when 4 then l_linenumber || '-' || (l_partkey + 20) || ' ' || l_partkey || '-' || l_partkey when 5 then 'none' when 6 then 'none' else l_linenumber || '-' || (l_partkey + 20) end spans from lineitem")
def mixed_spans(s, d):
    """Spans as objects, pairs, numbers with fractions, lists of either and broken ones, read by one reader."""
    x = table(s, d, "lineitem")
    a, b, form = F.col("l_linenumber"), F.col("l_partkey") + 20, (F.col("l_partkey") + F.col("l_linenumber")) % 7
    obj = lambda p, q: F.concat(F.lit('{"end": '), q, F.lit(', "start": '), p, F.lit("}"))
    forms = [obj(a, b), F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]")), F.concat(F.lit("["), a, F.lit(".75, "), b, F.lit(".2]")), F.when(F.col("l_partkey") % 2 == 0, "[]"), F.concat(F.lit("["), obj(a, b), F.lit(", ["), F.col("l_partkey"), F.lit(", "), F.col("l_partkey"), F.lit("]]")), F.concat(F.lit("["), b, F.lit(", "), a, F.lit("]")), F.lit('{"start": 1')]
    raw = forms[6]
    for i in range(6):
        raw = F.when(form == i, forms[i]).otherwise(raw)
    spans = F.transform(V.read_spans(raw, strict=False), lambda z: F.coalesce(F.concat(z["start"], F.lit("-"), z["end"]), F.lit("none")))
    return x.select("l_orderkey", "l_linenumber", F.array_join(spans, " ").alias("spans"))


#: Token budget of a history, and the messages at its end that stay.
BUDGET, RECENT = 260, 3
_TOTAL = "(16 + list_sum(list_transform(xs, lambda x: cast(ceil(length(x) / 3.0) as int) + 12)))"
_OLD, _TOKENS = "xs[li]", "cast(ceil(length(xs[li]) / 3.0) as int)"
_MOST = f"greatest(64, 3 * greatest(32, {_TOKENS} // 2))"
_SIDE = f"greatest(16, ({_MOST} - 27) // 2)"


@plan(PLANS, f"""with recursive c as (select conv_id, list(coalesce(text, '') order by turn, role, text) xs from conversations group by 1),
r as (select conv_id, xs, 0 removed from c union all select conv_id, [xs[1]] || xs[2 + least(2, len(xs) - 1 - {RECENT}):], removed + least(2, len(xs) - 1 - {RECENT}) from r where {_TOTAL} > {BUDGET} and len(xs) > 1 + {RECENT}),
t as (select conv_id, arg_max(xs, removed) xs, max(removed) removed from r group by 1),
s as (select conv_id, xs, removed, 0 shortened from t union all select conv_id, list_transform(xs, lambda x, i: case when i = li then new else x end), removed, shortened + 1 from
(select *, case when {_TOKENS} <= greatest(32, {_TOKENS} // 2) or length({_OLD}) <= {_MOST} then {_OLD} else left({_OLD}, {_SIDE}) || chr(10) || '...[TRUNCATED HISTORY]...' || chr(10) || right({_OLD}, greatest(16, {_MOST} - 27 - {_SIDE})) end new from
(select *, case when len(list_filter(xs[2:], lambda x: x <> '')) = 0 then 1 else 1 + list_position(list_transform(xs[2:], lambda x: length(x) + 2 - (length(x) + 2) % 3), list_max(list_transform(xs[2:], lambda x: length(x) + 2 - (length(x) + 2) % 3))) end li from s)) where {_TOTAL} > {BUDGET} and new <> {_OLD})
select conv_id, arg_max(xs, shortened) texts, any_value(removed) removed, max(shortened) shortened from s group by 1""")
def trimmed_histories(s, d):
    """All conversations cut to a budget: pairs of old turns go, then the longest texts lose their middles."""
    x = M.gather(table(s, d, "conversations").fillna("", ["text"])).select("conv_id", M.trim_history(F.col("messages"), BUDGET, RECENT).alias("t"))
    return x.select("conv_id", F.transform("t.messages", lambda m: m["content"]).alias("texts"), "t.removed", "t.shortened")


_HASHED = "list_sort(list_transform(range({first}, n), lambda i: {{'h': md5(conv_id || ':' || step || ':' || i), 'i': i}}))[:{drawn}]"


@plan(PLANS, rf"""with m as (select *, row_number() over (partition by conv_id order by turn) - 1 step from conversations), g as (select conv_id, conv_id // 2 number from conversations where conv_id % 10 <> 3 group by 1), c as (select conv_id, count(*) n from m group by 1),
x as (select m.conv_id run, m.conv_id, step, number, 6 + (step * 5) % 40 n, step % (6 + (step * 5) % 40) chosen from m join g using (conv_id) where step % 7 <> 6 and number >= 3),
k as (select *, case when n > 20 then list_sort(list_distinct(range(0, 6) || list_transform({_HASHED.format(first=6, drawn=10)}, lambda z: z.i) || [chosen])) else range(0, n) end kept from x)
select run, step, number, list_transform(kept, lambda i: 'act ' || i) actions, list_position(kept, chosen) - 1 chosen, n n_before, (select count(*) from c where conv_id % 10 = 3) missing from k""")
def choice_steps(s, d):
    """Conversations as shopping runs in JSON lines, read back, met with their goals, with long lists of choices reduced."""
    c = M.gather(table(s, d, "conversations")).select("conv_id", F.size("messages").alias("n"))
    steps = F.sequence(F.lit(0), F.col("n") - 1)
    count = lambda i: 6 + (i * 5) % 40
    runs = c.select(
        F.col("conv_id").alias("run"),
        F.transform(steps, lambda i: F.when(i == 0, F.concat(F.lit("WebShop\nInstruction:\nI'd like 'item' "), "conv_id", F.lit(", and price lower than 30\n[button] Search [button_]"))).otherwise(F.concat(F.lit("Page "), i.cast("string")))).alias("states"),
        F.transform(steps, lambda i: F.transform(F.sequence(F.lit(0), count(i) - 1), lambda j: F.concat(F.lit("Act "), j.cast("string")))).alias("available_actions"),
        F.transform(steps, lambda i: F.when(i % 7 == 6, -1).otherwise(i % count(i))).alias("action_idxs"),
    )
    path = f"{T.shared_dir(s)}/runs-{uuid.uuid4().hex}"
    T.append_records(runs, path)
    back, _ = T.read_jsonl(s, path, "run long, states array<string>, available_actions array<array<string>>, action_idxs array<int>")
    goals = c.where("conv_id % 10 <> 3").select(F.concat(F.lit("id like item "), "conv_id").alias("goal"), F.floor(F.col("conv_id") / 2).alias("number"))
    rows, missing = SH.choice_rows(back, goals, 3)
    return rows.drop("state").crossJoin(missing.agg(F.count("*").alias("missing")))


@plan(PLANS, "select o_orderkey % 3 part, count(*) n, sum(o_orderkey)::bigint keys from orders group by 1")
def versioned_parts(s, d):
    """Orders in three parts of one version, the second of them written twice, beside a part of an older version."""
    log, old = (PartLog(s, f"{T.shared_dir(s)}/parts-{d.rstrip('/').rsplit('/', 1)[-1]}-{run}", v) for run in [uuid.uuid4().hex] for v in ("2", "1"))
    o = table(s, d, "orders").select("o_orderkey")
    old.write(o.limit(10), 0)
    for part in (0, 1, 1, 2):
        log.write(o.where(F.col("o_orderkey") % 3 == part), part)
    return log.read().groupBy((F.col("o_orderkey") % 3).alias("part")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@plan(PLANS, "select o_orderkey, case when o_orderkey % 101 = 7 then 0 else 1 end + case when o_orderkey % 97 = 5 then 1 else 0 end b_n, 1 a_n from orders where (o_orderkey % 101 = 7 or o_orderkey % 97 = 5 or o_orderkey % 89 = 3) and not (o_orderkey % 101 = 7 and o_orderkey % 97 = 5)")
def table_differences(s, d):
    """Orders against a copy that lacks some rows, repeats some and differs in one column in others."""
    a = table(s, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    k = F.col("o_orderkey")
    b = a.where(k % 101 != 7).withColumn("o_totalprice", F.when(k % 89 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).union(a.where(k % 97 == 5))
    return C.differing_keys(a, b, "o_orderkey").select("o_orderkey", F.col("a_n").cast("int").alias("a_n"), F.col("b_n").cast("int").alias("b_n"))


@plan(PLANS, "with e as (select user_id, value, event_id % 5 batch from events where value is not null), l as (select user_id, max(batch) batch from e group by 1) select user_id, round(avg(value), 6) mean from e join l using (user_id, batch) group by 1")
def running_baselines(s, d):
    """Five micro-batches of events into a table of running baselines that is compacted on the way, one of them twice."""
    e = table(s, d, "events").where("value is not null")
    base = K.BaselineTable(f"{T.shared_dir(s)}/baselines-{uuid.uuid4().hex}", "user_id", "value", compact_every=3)
    for epoch in (0, 1, 1, 2, 3, 4):
        base.upsert(e.where(F.col("event_id") % 5 == epoch), epoch)
    return base.read(s).select("user_id", F.round("mean", 6).alias("mean"))


_GAP = "interval 6 hours"


@plan(PLANS, f"""with e as (select user_id, ts, event_id, event_type, coalesce(value, 0) v, lag(ts) over w p, lag(event_type) over w pk from events where ts is not null window w as (partition by user_id order by ts, event_id)),
x as (select *, sum(case when p is null or pk = 'purchase' or ts - p > {_GAP} then 1 else 0 end) over (partition by user_id order by ts, event_id) run from e),
r as (select *, row_number() over q n, sum(v) over q total, sum(cast(event_type = 'view' as int)) over q views, lead(ts) over (partition by user_id order by ts, event_id) nxt, lead(run) over (partition by user_id order by ts, event_id) nrun from x window q as (partition by user_id, run order by ts, event_id)),
o as (select *, 'closed' reason from r where event_type = 'purchase' union all select *, 'every' from r where event_type <> 'purchase' and n % 3 = 0 union all select *, 'expired' from r where event_type <> 'purchase' and (nrun <> run or nxt is null and (select max(ts) from events) - interval 1 hour > ts + {_GAP}))
select user_id, reason, n, round(total, 4) total, views::bigint views from o""")
def session_rows(s, d):
    """All events as a stream through keyed state with timers, on a checkpoint in the shared folder."""
    at = f"{T.shared_dir(s)}/sessions-{uuid.uuid4().hex}"
    with K.rocks(s):
        known = table(s, d, "events")
        e = s.readStream.schema(known.schema).option("pathGlobFilter", "events.parquet").parquet(d)
        rows = K.keyed_sessions(e, "user_id", "ts", "event_id", "event_type", "value", close="purchase", idle="6 hours", every=3, late="1 hour", buckets=parts_by_rows(known, 5_000))
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
        q.awaitTermination()
    x = s.read.schema(rows.schema).parquet(f"{at}/out")
    return x.select(F.col("key").alias("user_id"), "reason", "n", F.round("total", 4).alias("total"), F.coalesce(F.try_element_at("kinds", F.lit("view")), F.lit(0)).alias("views"))
