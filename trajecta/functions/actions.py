"""Actions in the messages of each environment, and what environments show, as JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajecta.functions import text as X

# Formats of the messages.
THINK_ANY = r"(?is)<think>.*?</think>"
THINK_TAG = r"(?i)</?think>"
THINK_LOWER = r"(?s)<think>.*?</think>"
BRACKETS = r"\[\[([^\]]+)\]\]"
ACTION_TAG = r"(?s)<action>(.*?)</action>"
ACTION_TEXT = r"(?is)Action:\s*(.+?)(?:\n|$)"
ACTION_REST = r"(?i)Action:\s*(.+)"
SEARCH_CALL = r"(?i)\b(search|click|answer)\s*\[([^\]]+)\]"
COMMANDS = r"(?ims)Crafting commands:\n(.+?)\n\nGoal:\s*craft\s+.+?\.?$"
GRID_WORDS = ("turn", "move", "pickup", "drop", "toggle", "go to", "go through", "check")
NO_ACTION = ("thought:", "think:", "action:")
ACTIONS_HEAD = "AVAILABLE ACTIONS: "

# The sources that rows carry, here and at the parsers below.
PARSERS: dict[str, Callable[[Column], Column]] = {"textcraft": X.action_strict}


def parser(name: str):
    """Decorator: the parser of an environment; a later one of the same name takes its place."""

    def put(f):
        PARSERS[name] = f
        return f

    return put


def action_for(source: Column, text: Column, parsers: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The action by the parser of each row's source; null for a source without one."""
    out = None
    for name, f in (PARSERS if parsers is None else parsers).items():
        out = F.when(source == name, f(text)) if out is None else out.when(source == name, f(text))
    return F.lit(None).cast("string") if out is None else out


def unbracket(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\[\[\s*", ""), r"\s*\]\]$", "")


def last_of(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def last_line(c: Column, rule: Callable[[Column], Column]) -> Column:
    """The last line, stripped, that is not empty, has under 100 characters and meets the rule."""
    lines = F.transform(F.split(c, "\n"), lambda x: X.strip(x))
    return last_of(F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 100) & rule(x)))


@parser("sciworld")
def science(c: Column) -> Column:
    """Last double bracket, else the first action line, of the raw text and then of the text without think tags; no other line counts."""

    def tidy(x: Column) -> Column:
        a = F.lower(X.collapse(unbracket(X.strip(x))))
        return F.when((a != "") & ~a.rlike("[<>]") & ~a.isin(*NO_ACTION) & (F.length(a) <= 200), a)

    def look(t: Column) -> Column:
        return F.coalesce(tidy(last_of(F.regexp_extract_all(t, F.lit(X.BRACKET), 1))), tidy(X.none_if_empty(F.regexp_extract(t, ACTION_TEXT, 1))))

    raw = X.strip(c)
    bare = F.regexp_replace(F.regexp_replace(X.strip_chat_markers(raw), THINK_ANY, ""), THINK_TAG, "")
    return F.coalesce(look(raw), look(bare))


@parser("alfworld")
def household(c: Column) -> Column:
    """First double bracket that holds something, else the first action line, else the last short line."""
    t = F.regexp_replace(X.strip(c), THINK_LOWER, "")
    boxed = F.filter(F.transform(F.regexp_extract_all(t, F.lit(BRACKETS), 1), lambda x: X.strip(x)), lambda x: x != "")
    said = F.regexp_extract_all(t, F.lit(ACTION_REST), 1)
    first = lambda a: F.when(F.size(a) > 0, F.element_at(a, 1))
    line = last_line(X.strip(t), lambda x: F.lit(True))
    return F.lower(F.coalesce(first(boxed), unbracket(X.strip(first(said))), unbracket(line)))


@parser("babyai")
def grid(c: Column) -> Column:
    """Last double bracket, else an action tag, else the first action line, else the last short line with a word of the grid."""
    t = F.regexp_replace(X.strip_chat_markers(X.strip(c)), THINK_LOWER, "")
    boxed = X.none_if_empty(X.collapse(last_of(F.regexp_extract_all(t, F.lit(X.BRACKET), 1))))
    tagged = F.when(t.rlike(ACTION_TAG), X.strip(F.regexp_extract(t, ACTION_TAG, 1)))
    said = X.none_if_empty(unbracket(X.strip(F.regexp_extract(t, r"(?i)Action:\s*(.+?)(?:\n|$)", 1))))
    line = last_line(X.strip(t), lambda x: F.exists(F.array(*map(F.lit, GRID_WORDS)), lambda k: F.contains(F.lower(x), k)))
    return F.lower(F.coalesce(boxed, tagged, said, line))


@parser("searchqa")
def qa_search(c: Column) -> Column:
    """search[..], click[..] or answer[..] of the last double bracket, or of the text where there is none."""
    t = F.regexp_replace(X.strip_chat_markers(X.strip(c)), THINK_LOWER, "")
    t = F.coalesce(last_of(F.regexp_extract_all(t, F.lit(X.BRACKET), 1)), t)
    return F.when(t.rlike(SEARCH_CALL), F.concat(F.lower(F.regexp_extract(t, SEARCH_CALL, 1)), F.lit("["), X.strip(F.regexp_extract(t, SEARCH_CALL, 2)), F.lit("]")))


@parser("webshop")
def store(c: Column) -> Column:
    """After the last action mark the first search, else the first click; without one the last search of the text, else its last click."""

    def call(t: Column, name: str, pick: int) -> Column:
        found = F.regexp_extract_all(t, F.lit(rf"(?i){name}\[([^\]]*)\]"), 1)
        return F.when(F.size(found) > 0, F.concat(F.lit(f"{name}["), F.element_at(found, pick), F.lit("]")))

    said = F.when(c.contains("Action:"), F.element_at(F.split(c, "Action:"), -1))
    loose = F.when(c.contains("search[") | c.contains("click["), F.coalesce(call(c, "search", -1), call(c, "click", -1)))
    return F.coalesce(call(said, "search", 1), call(said, "click", 1), loose)


def with_actions(observation: Column, actions: Column) -> Column:
    """The observation with the list of admissible actions after it, unless there are none or it has one."""
    seen = F.regexp_replace(F.coalesce(observation, F.lit("")), r"\s+$", "")
    said = F.array_join(F.filter(F.transform(actions, lambda a: X.strip(a)), lambda a: a != ""), ",")
    bare = actions.isNull() | (F.size(actions) == 0)
    return F.when(bare, observation).when(F.contains(F.lower(seen), F.lit("available actions:")) | (said == ""), seen).otherwise(F.concat(seen, F.lit("\n" + ACTIONS_HEAD), said))


def goal_and_commands(messages: Column) -> Column:
    """struct(goal, commands) of the first user message with a goal; commands are null where it lists none."""
    user = F.filter(messages, lambda m: (m["role"] == "user") & X.goal(m["content"]).isNotNull())
    first = F.try_element_at(user, F.lit(1))["content"]
    return F.struct(X.goal(first).alias("goal"), X.none_if_empty(X.strip(F.regexp_extract(first, COMMANDS, 1))).alias("commands"))
