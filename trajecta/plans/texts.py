"""Text operators over ``documents``, ``pages`` and texts made from ``part`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.plans.base import plan, table

PLANS: dict = {}

#: Messages with thoughts and actions in several forms, made from part names.
MSG = """select p_partkey k, case p_partkey % 5 when 0 then 'Thought: need ' || p_name || chr(10) || 'Action: get 1 ' || p_name || '!' when 1 then '<think> make it </think> Action: [[ Craft ' || p_name || ' ]]'
when 2 then 'Action: get a' || chr(10) || 'Action: get b' when 3 then 'I go to ' || p_name || chr(10) || 'Move  forward' || chr(10) else 'OK. I''ll follow your instructions.' end m, p_name, p_retailprice price, p_size from part"""


def messages(s, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    m = F.when(k % 5 == 0, F.concat(F.lit("Thought: need "), n, F.lit("\nAction: get 1 "), n, F.lit("!"))).when(k % 5 == 1, F.concat(F.lit("<think> make it </think> Action: [[ Craft "), n, F.lit(" ]]"))).when(k % 5 == 2, F.lit("Action: get a\nAction: get b")).when(k % 5 == 3, F.concat(F.lit("I go to "), n, F.lit("\nMove  forward\n"))).otherwise(F.lit("OK. I'll follow your instructions."))
    return table(s, d, "part").select(k.alias("k"), m.alias("m"), "p_name", F.col("p_retailprice").alias("price"), "p_size")


CLEAN = "regexp_replace({}, '[^A-Za-z0-9, ]+', '', 'g')"


@plan(PLANS, f"with m as ({MSG}) select k, case k % 5 when 0 then 'get 1 ' || trim({CLEAN.format('p_name')}) when 1 then trim('Craft ' || {CLEAN.format('p_name')}) end action, case k % 5 when 2 then 'multiple_action_tags' when 3 then 'missing_action_tag' end status from m")
def strict_actions(s, d):
    m = F.col("m")
    return messages(s, d).select("k", X.action_strict(m).alias("action"), X.action_status(m).alias("status"))


@plan(PLANS, f"with m as ({MSG}) select k, case k % 5 when 0 then 'get 1 ' || lower(p_name) || '!' when 1 then 'craft ' || lower(p_name) when 2 then 'get b' end action, case k % 5 when 0 then 'line' when 1 then 'bracket' when 2 then 'line' else 'none' end mode_name from m")
def loose_actions(s, d):
    x = messages(s, d).withColumn("a", X.action_loose(F.col("m")))
    return x.select("k", F.col("a.action").alias("action"), F.col("a.mode").alias("mode_name"))


@plan(PLANS, f"with m as ({MSG}), w as (select k, lower(p_name) n, regexp_matches(lower(p_name), 'turn|move|pickup|pick up|drop|toggle|go to|go through|check') has from m) select k, case when k % 5 = 0 and has then 'action: get 1 ' || n || '!' when k % 5 = 1 and has then 'action: [[ craft ' || n || ' ]]' when k % 5 = 3 then 'move forward' end line from w")
def plausible_action_line(s, d):
    return messages(s, d).select("k", X.plausible_last_line(F.col("m")).alias("line"))


@plan(PLANS, f"with m as ({MSG}) select k, case k % 5 when 0 then 'need ' || p_name when 1 then 'make it' end thought, case k % 5 when 0 then 'Think: need ' || p_name || chr(10) || 'Action: [[ get 1 ' || trim({CLEAN.format('p_name')}) || ' ]]' when 1 then 'Think: make it' || chr(10) || 'Action: [[ ' || trim('Craft ' || {CLEAN.format('p_name')}) || ' ]]' else m end canonical from m")
def thoughts_and_canonical(s, d):
    m = F.col("m")
    return messages(s, d).select("k", X.thought(m).alias("thought"), X.canonical_assistant(m).alias("canonical"))


@plan(PLANS, "select k, p_name goal from (select p_partkey k, p_name from part)")
def goal_extraction(s, d):
    g = table(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("Instructions here.\nGoal: craft "), "p_name", F.lit(".\nInventory: none")).alias("c"))
    return g.select("k", X.goal(F.col("c")).alias("goal"))


@plan(PLANS, r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>|<title\b[^>]*>.*?</title>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) visible from pages".replace('\\"', '"'))
def visible_page_text(s, d):
    return table(s, d, "pages").select("page_id", X.visible_text(F.col("html")).alias("visible"))


@plan(PLANS, "select p_partkey k, case when p_partkey % 3 = 0 then [100.0::double] when p_partkey % 3 = 1 then [p_retailprice] else [p_retailprice, p_retailprice + 1] end prices from part")
def price_parse(s, d):
    p = F.format_string("%.2f", F.col("p_retailprice"))
    t = F.when(F.col("p_partkey") % 3 == 0, F.lit("price on request")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("now $"), p)).otherwise(F.concat(F.lit("$"), p, F.lit(" to $"), F.format_string("%.2f", F.col("p_retailprice") + 1), F.lit(" or $1.00")))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), X.prices(t).alias("prices"))


@plan(PLANS, "select p_partkey k, [(floor(p_retailprice / 2 / 10) + i) * 10 for i in [1, 2, 3, 4] if (floor(p_retailprice / 2 / 10) + i) * 10 <= 990] bounds from part")
def price_bounds(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.transform(X.price_bounds(F.col("p_retailprice") / 2), lambda x: x.cast("double")).alias("bounds"))


@plan(PLANS, "select o_orderkey k, cast(o_orderkey as varchar) last_number, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) end marked from orders")
def number_answers(s, d):
    t = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("so #### "), F.col("o_custkey").cast("string"), F.lit(" is it; "))).otherwise(F.lit("")), F.lit("the total is $"), F.col("o_orderkey").cast("string"), F.lit("."))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), X.last_number(t).alias("last_number"), X.marked_answer(t).alias("marked"))


# Without SQL: DuckDB's \b knows ASCII words only.
@plan(PLANS)
def answer_normalisation(s, d):
    return table(s, d, "documents").select("doc_id", X.normalize_answer(F.col("text")).alias("normal"))


@plan(PLANS, "select p_partkey k, p_name answer, true exact from part")
def answer_tags(s, d):
    t = F.concat(F.lit("<answer>no</answer> then <answer> "), "p_name", F.lit(" </answer>"))
    x = table(s, d, "part").select(F.col("p_partkey").alias("k"), X.answer_tag(t).alias("answer"), "p_name")
    return x.select("k", "answer", (X.normalize_answer(F.col("answer")) == X.normalize_answer(F.concat(F.lit("The "), "p_name"))).alias("exact"))


@plan(PLANS, "select doc_id, upper(substr(sha1(text), 1, 10)) code from documents")
def sha_codes(s, d):
    return table(s, d, "documents").select("doc_id", X.code10(F.col("text")).alias("code"))


@plan(PLANS, "select p_partkey k, case when p_partkey % 2 = 0 then 'search' end name, case when p_partkey % 2 = 0 then p_name end arg from part")
def web_actions(s, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("search["), "p_name", F.lit("]"))).otherwise(F.concat(F.lit("look at "), "p_name"))
    x = table(s, d, "part").select(F.col("p_partkey").alias("k"), X.web_action(t).alias("w"))
    return x.select("k", F.col("w.name").alias("name"), F.col("w.arg").alias("arg"))


@plan(PLANS, "select p_partkey k, case p_partkey % 4 when 0 then 'select 1' when 1 then 'x' when 2 then 'show tables' else 'select ' || p_partkey end q from part")
def sql_extraction(s, d):
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, F.lit("so ```sql\nselect 1\n``` or ```x```")).when(k % 4 == 1, F.lit("```\nx\n```")).when(k % 4 == 2, F.lit("Action: show tables")).otherwise(F.concat(F.lit("run\nselect "), k.cast("string"), F.lit("\nthanks")))
    return table(s, d, "part").select(k.alias("k"), X.sql_of(t).alias("q"))


@plan(PLANS, "select p_partkey k, 'find' name, cast(p_size as varchar) size_arg, 1 n from part")
def tool_call_parse(s, d):
    t = F.concat(F.lit('go <tool_call>{"name": "find", "arguments": {"size": '), F.col("p_size").cast("string"), F.lit('}}</tool_call> and <tool_call>{bad</tool_call>'))
    x = table(s, d, "part").select(F.col("p_partkey").alias("k"), X.tool_calls(t).alias("c"))
    return x.select("k", F.col("c")[0]["name"].alias("name"), F.get_json_object(F.col("c")[0]["arguments"], "$.size").alias("size_arg"), F.size("c").alias("n"))


@plan(PLANS, "select p_partkey k, ['text', 'image', 'text', 'video'] kinds, p_name first_text from part")
def media_placeholders(s, d):
    x = table(s, d, "part").select(F.col("p_partkey").alias("k"), X.media_parts(F.concat("p_name", F.lit("<image>see<video>"))).alias("p"))
    return x.select("k", F.transform("p", lambda v: v["type"]).alias("kinds"), F.col("p")[0]["text"].alias("first_text"))


@plan(PLANS, "select doc_id, case when length(text) > 100 then substr(text, 1, 50) || '...' || right(text, 50) else text end cut, cast(ceil(length(text) / 4.0) as bigint) tokens from documents")
def truncate_and_estimate(s, d):
    return table(s, d, "documents").select("doc_id", X.middle_truncate(F.col("text"), 100).alias("cut"), X.token_estimate(F.col("text")).alias("tokens"))


# Colours and size patterns for the tests of normalisation.
COLORS = ["red", "green", "blue", "lavender", "white", "black"]
SIZES = ["x-large", "medium", "large", "small", "(.*)plus", "(.*)inch"]


@plan(PLANS, "select p_partkey k, case p_partkey % 3 when 0 then 'lavender' when 1 then 'red' else p_name end color, case p_partkey % 3 when 0 then '(.*)plus' when 1 then 'numeric_size' else 'not_matched' end size from part")
def color_and_size(s, d):
    k = F.col("p_partkey") % 3
    c = F.when(k == 0, "violet lavender").when(k == 1, "dark red").otherwise(F.col("p_name"))
    z = F.when(k == 0, "40cm plus").when(k == 1, "14.2").otherwise("huge")
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), F.when(k == 2, F.col("p_name")).otherwise(X.normalize_color(c, COLORS)).alias("color"), X.normalize_size(z, SIZES).alias("size"))


@plan(PLANS, "select event_id, try_cast(case when event_id % 3 = 0 then 'nope' when event_id % 3 = 1 then 'NaN' else cast(event_id as varchar) end as double) x from events where event_id % 3 <> 1 union all select event_id, null from events where event_id % 3 = 1")
def null_safe_numbers(s, d):
    e = F.col("event_id")
    t = F.when(e % 3 == 0, "nope").when(e % 3 == 1, "NaN").otherwise(e.cast("string"))
    return table(s, d, "events").select("event_id", X.null_safe_double(t).alias("x"))


@plan(PLANS, "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) flat from documents")
def whitespace_collapse(s, d):
    return table(s, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("flat"))


@plan(PLANS, "select doc_id, text stripped from documents")
def chat_marker_strip(s, d):
    t = F.concat(F.lit("<|im_start|>assistant\n"), "text", F.lit("<|im_end|>"))
    return table(s, d, "documents").select("doc_id", X.strip_chat_markers(t).alias("stripped"))
