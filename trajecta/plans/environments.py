"""Environments: action parsers, observations, pages, sessions and episodes over messages made from ``part`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajecta.functions import actions as A
from trajecta.functions import pages as P
from trajecta.functions import text as X
from trajecta.operators import messages as M
from trajecta.operators import shop as SH
from trajecta.operators import stateful as S
from trajecta.operators.batch import spread
from trajecta.plans.base import plan, shipped, table

PLANS: dict = {}

#: Messages in the forms that the parsers tell apart.
MSG = """select p_partkey k, case p_partkey % 7 when 0 then '<think>turn it</think> [[ Go  to ' || p_name || ' ]] and [[ look ]]' when 1 then 'Thought: x' || chr(10) || 'Action:  Move ' || p_name || chr(10) || 'then rest'
when 2 then 'I would' || chr(10) || '<action> Drop ' || p_name || ' </action>' when 3 then 'Search[' || p_name || '] then Answer [ ' || p_type || ' ]' when 4 then 'nothing' || chr(10) || 'Toggle ' || p_name || chr(10) || '  '
when 5 then '<think> [[ take ' || p_name || ' ]] </think>' else 'Action: click[' || p_brand || '] or click[next]' || chr(10) || '[[ < ' || p_name || ' > ]]' end t from part"""


def messages(s, d):
    k, n, lit = F.col("p_partkey") % 7, F.col("p_name"), F.lit
    forms = [
        F.concat(lit("<think>turn it</think> [[ Go  to "), n, lit(" ]] and [[ look ]]")),
        F.concat(lit("Thought: x\nAction:  Move "), n, lit("\nthen rest")),
        F.concat(lit("I would\n<action> Drop "), n, lit(" </action>")),
        F.concat(lit("Search["), n, lit("] then Answer [ "), F.col("p_type"), lit(" ]")),
        F.concat(lit("nothing\nToggle "), n, lit("\n  ")),
        F.concat(lit("<think> [[ take "), n, lit(" ]] </think>")),
        F.concat(lit("Action: click["), F.col("p_brand"), lit("] or click[next]\n[[ < "), n, lit(" > ]]")),
    ]
    t = forms[6]
    for i in range(6):
        t = F.when(k == i, forms[i]).otherwise(t)
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), t.alias("t"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
NOTHINK = r"regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')"
LINES = rf"list_filter(list_transform(string_split({NOTHINK}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: length(x) > 0 and length(x) < 100)"


@plan(PLANS, rf"""with m as ({MSG}), b as (select k, regexp_extract_all(t, '(?s)\[\[\s*(.*?)\s*\]\]', 1)[-1] box, nullif(regexp_extract(t, '(?is)Action:\s*(.+?)(?:\n|$)', 1), '') said from m), c as (select k, lower({SQUEEZE.format('box')}) x, lower({SQUEEZE.format('said')}) y from b)
select k, coalesce(case when x <> '' and not regexp_matches(x, '[<>]') then x end, case when y <> '' and not regexp_matches(y, '[<>]') then y end) "action" from c""")
def science_actions(s, d):
    return messages(s, d).select("k", A.PARSERS["sciworld"](F.col("t")).alias("action"))


@plan(PLANS, rf"""with m as ({MSG}), b as (select k, list_filter(list_transform(regexp_extract_all({NOTHINK}, '\[\[([^\]]+)\]\]', 1), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1] box, regexp_extract_all({NOTHINK}, '(?i)Action:\s*(.+)', 1)[1] said, {LINES}[-1] line from m)
select k, lower(coalesce(box, {STRIP.format('said')}, line)) "action" from b""")
def household_actions(s, d):
    return messages(s, d).select("k", A.PARSERS["alfworld"](F.col("t")).alias("action"))


@plan(PLANS, rf"""with m as ({MSG}), b as (select k, nullif({SQUEEZE.format(rf"regexp_extract_all({NOTHINK}, '(?s)\[\[\s*(.*?)\s*\]\]', 1)[-1]")}, '') box, regexp_extract_all({NOTHINK}, '(?s)<action>(.*?)</action>', 1)[1] tag, regexp_extract_all({NOTHINK}, '(?i)Action:\s*(.+?)(?:\n|$)', 1)[1] said,
list_filter({LINES}, lambda x: regexp_matches(lower(x), 'turn|move|pickup|drop|toggle|go to|go through|check'))[-1] line from m)
select k, lower(coalesce(box, {STRIP.format('tag')}, {STRIP.format('said')}, line)) "action" from b""")
def grid_actions(s, d):
    return messages(s, d).select("k", A.PARSERS["babyai"](F.col("t")).alias("action"))


@plan(PLANS, rf"""with m as ({MSG}), b as (select k, coalesce(regexp_extract_all({NOTHINK}, '(?s)\[\[\s*(.*?)\s*\]\]', 1)[-1], {NOTHINK}) t from m)
select k, case when regexp_matches(t, '(?i)\b(search|click|answer)\s*\[([^\]]+)\]') then lower(regexp_extract(t, '(?i)\b(search|click|answer)\s*\[([^\]]+)\]', 1)) || '[' || {STRIP.format(r"regexp_extract(t, '(?i)\b(search|click|answer)\s*\[([^\]]+)\]', 2)")} || ']' end "action" from b""")
def qa_search_actions(s, d):
    return messages(s, d).select("k", A.PARSERS["searchqa"](F.col("t")).alias("action"))


@plan(PLANS, rf"""with m as ({MSG}), b as (select k, t, case when contains(t, 'Action:') then string_split(t, 'Action:')[-1] end said from m), c as (select k, t, regexp_extract_all(said, '(?i)search\[([^\]]*)\]', 1)[1] s1, regexp_extract_all(said, '(?i)click\[([^\]]*)\]', 1)[1] c1, regexp_extract_all(t, '(?i)search\[([^\]]*)\]', 1)[-1] s2, regexp_extract_all(t, '(?i)click\[([^\]]*)\]', 1)[-1] c2 from b)
select k, coalesce('search[' || s1 || ']', 'click[' || c1 || ']', case when contains(t, 'search[') or contains(t, 'click[') then coalesce('search[' || s2 || ']', 'click[' || c2 || ']') end) "action" from c""")
def store_actions(s, d):
    return messages(s, d).select("k", A.PARSERS["webshop"](F.col("t")).alias("action"))


#: Sources in turn, one of them without a parser.
SOURCES = ("textcraft", "sciworld", "alfworld", "babyai", "searchqa", "webshop", "other")
STRICT = rf"""with m as ({MSG}), b as (select k, regexp_extract_all(t, 'Action:\s*([^\n]*)', 1) said from m) select k, case when len(said) = 1 then nullif({SQUEEZE.format("regexp_replace(said[1], '[^A-Za-z0-9, ]+', '', 'g')")}, '') end "action" from b"""
_EACH = dict(zip(SOURCES, (STRICT, *(PLANS[n][1] for n in ("science_actions", "household_actions", "grid_actions", "qa_search_actions", "store_actions"))), strict=False))


@plan(PLANS, "select k, 'other' source, cast(null as varchar) \"action\" from (" + MSG + ") where (k // 7) % 7 = 6" + "".join(f" union all select k, '{n}', \"action\" from ({sql}) where (k // 7) % 7 = {i}" for i, (n, sql) in enumerate(_EACH.items())))
def parsers_by_source(s, d):
    """Every form of message under every source, by the registry of parsers."""
    x = messages(s, d).withColumn("source", F.element_at(F.array(*map(F.lit, SOURCES)), (F.floor(F.col("k") / 7) % 7 + 1).cast("int")))
    return x.select("k", "source", A.action_for(F.col("source"), F.col("t")).alias("action"))


@plan(PLANS, "select p_partkey k, case p_partkey % 4 when 0 then p_name || '  ' when 1 then p_name || chr(10) || 'AVAILABLE ACTIONS: ' || p_type || ',look' when 2 then p_name || ' Available actions: x' else p_name end seen from part")
def observations_with_actions(s, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    obs = F.when(k == 2, F.concat(n, F.lit(" Available actions: x"))).otherwise(F.concat(n, F.lit("  ")))
    acts = F.when(k == 0, F.array().cast("array<string>")).when(k == 3, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" "), "p_type"), F.lit(""), F.lit("look")))
    return table(s, d, "part").select(F.col("p_partkey").alias("k"), A.with_actions(obs, acts).alias("seen"))


@plan(PLANS, "select p_partkey k, case when p_partkey % 3 < 2 then p_name end goal, case when p_partkey % 3 = 0 then 'craft 1 ' || p_type || ' using 2 log' end commands from part")
def goals_and_commands(s, d):
    k, n = F.col("p_partkey") % 3, F.col("p_name")
    goal = F.concat(F.lit("Goal: craft "), n, F.lit("."))
    t = F.when(k == 0, F.concat(F.lit("Crafting commands:\ncraft 1 "), F.col("p_type"), F.lit(" using 2 log\n\n"), goal)).when(k == 1, F.concat(F.lit("Do this. \n"), goal)).otherwise(n)
    m = F.array(F.struct(F.lit("user").alias("role"), F.lit("hello").alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit("Goal: craft nothing.").alias("content")), F.struct(F.lit("user").alias("role"), t.alias("content")))
    x = table(s, d, "part").select("p_partkey", A.goal_and_commands(m).alias("g"))
    return x.select(F.col("p_partkey").alias("k"), "g.goal", "g.commands")


#: All Unicode white space, as DuckDB writes it.
SPACES = r"[\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@plan(PLANS, rf"select doc_id, case when trim(regexp_replace(text, '{SPACES}', ' ', 'g')) <> '' then trim(regexp_replace(text, '{SPACES}', ' ', 'g')) || ' [SEP] ' else '' end || '[button] ' || source || ' & co [button_]' seen from documents")
def page_round_trip(s, d):
    """All documents rendered as pages and read back as observations; pieces are those of the one paragraph and the button."""
    page = X.render_page(F.col("lang"), F.array(F.col("text")), F.array(F.concat("source", F.lit(" & co"))))
    return table(s, d, "documents").select("doc_id", X.page_observation(page).alias("seen"))


@plan(PLANS)
def page_texts(s, d):
    """The visible texts of all pages with the elements around them, by a stack of open tags (a test holds it against an event-driven parser)."""
    nodes = table(s, d, "pages").select("page_id", P.page_nodes(F.col("html")).alias("n"))
    return nodes.select("page_id", F.posexplode("n").alias("place", "n")).select("page_id", "place", "n.text", "n.tag", "n.class")


@plan(PLANS, """select p_partkey k, case when p_partkey % 3 = 0 then 'You have clicked size ' || p_size || '.' || chr(10) else '' end || p_name || chr(10) || case when p_partkey % 2 = 0 then chr(10) || '[clicked button] B' || p_partkey || ' [clicked button_]' else chr(10) || '[button] B' || p_partkey || ' [button_]' end || chr(10)
|| 'by ' || p_brand || ' <' || p_type || '>' || chr(10) || case when p_partkey % 3 = 0 then '  [clicked button] size ' || p_size || ' [clicked button_]' else '  [button] size ' || p_size || ' [button_]' end || chr(10) || '[button] Buy & go [button_]' || chr(10) rich,
p_name || ' [SEP] B' || p_partkey || ' [SEP] by ' || p_brand || ' <' || p_type || '> [SEP] size ' || p_size || ' [SEP] Buy & go' simple from part""")
def product_pages(s, d):
    """Product pages with nested, void and stray tags, read in the rich and the simple form."""
    lit, name = F.lit, lambda c: X.escape_html(F.col(c))
    page = F.concat(
        lit("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>\n<script>if (a < b) { '<p>no</p>' }</script><div><h2>"), name("p_name"), lit("</b></h2><!-- <p>no</p> -->\n<a class=\"product-link\" href='/a>b'>B"), F.col("p_partkey"),
        lit("</a><br/><p>by "), name("p_brand"), lit(" < ".strip()), F.col("p_type"), lit("&gt;<img src=x></p></div><LABEL for='s'>size "), F.col("p_size"), lit("</LABEL><div><button class=buy><i></i>Buy &amp; go</div></button></body></html>\n"),
    )
    # "<" before a letter would open a tag, so it is written as an entity there
    page = F.replace(page, F.concat(name("p_brand"), lit("<"), F.col("p_type")), F.concat(name("p_brand"), lit(" &lt;"), F.col("p_type")))
    nodes, k = P.page_nodes(page), F.col("p_partkey")
    url = F.when(k % 3 == 0, F.concat(lit('/item/{"size": "size '), "p_size", lit('"}'))).otherwise(F.concat(lit("/item/size "), "p_size"))
    seen = F.when(k % 2 == 0, F.array(lit("B0"), F.concat(lit("B"), k))).otherwise(F.array().cast("array<string>"))
    x = spread(table(s, d, "part"), "p_partkey").select(k.alias("k"), nodes.alias("n"), url.alias("url"), seen.alias("seen"))
    return x.select("k", P.rich_observation(F.col("n"), F.col("url"), F.col("seen")).alias("rich"), P.simple_observation(F.col("n")).alias("simple"))


@plan(PLANS, "select conv_id, string_agg('Doc ' || i || '(Title: ' || role || ') ' || text, chr(10) order by i) shown from (select *, row_number() over (partition by conv_id order by turn) i from conversations) group by 1")
def search_passages(s, d):
    c = M.gather(table(s, d, "conversations"))
    return c.select("conv_id", S.passages(F.transform("messages", lambda m: F.struct(m["role"].alias("title"), m["content"].alias("text")))).alias("shown"))


CAPS = {"assistant_turns": 6, "user_turns": 5, "tokens": 400, "interaction": True}
KINDS = ("start", "generated", "tools", "reply")


@plan(PLANS)
def episode_states(s, d):
    e = shipped(s, d, "events").withColumns({"kind": F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 4 + 1).cast("int")), "calls": F.col("event_id") % 2, "tokens": F.col("event_id") % 50, "stop": F.col("event_id") % 9 == 0})
    return S.run_episodes(e, CAPS, "user_id", "event_id", "kind", "calls", "tokens", "stop")


SHOP = {"apple": {"color": ["red", "green"]}, "pear": {}}


@plan(PLANS)
def shop_sessions(s, d):
    acts = ["search[fruit]", "click[apple]", "click[Red]", "click[reviews]", "click[< Prev]", "click[buy now]", "click[next >]", "dance[]"]
    e = shipped(s, d, "events").select("user_id", "event_id", F.element_at(F.array(*map(F.lit, acts)), (F.col("event_id") % len(acts) + 1).cast("int")).alias("action"))
    show = lambda x: (x["page"], x["keywords"], x["number"], x["asin"], x["options"].get("color"), sum(x["actions"].values()), x["reward"], x["done"])
    return S.fold_sessions(e, "user_id", "event_id", ["action"], "page string, keywords string, number long, asin string, color string, n_actions long, reward double, done boolean", lambda *_: SH.start_session("apple"), lambda st, a: SH.shop_step(st, a, SHOP), show)


@plan(PLANS, "select event_id, value * 2 doubled, event_type kind from events")
def service_calls(s, d):
    e = shipped(s, d, "events").select("event_id", "value", "event_type")
    return S.batched_calls(e, lambda rows: [{"event_id": r["event_id"], "doubled": r["value"] * 2, "kind": r["event_type"]} for r in rows], "event_id long, doubled double, kind string", at_once=4)
