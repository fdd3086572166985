"""Keyed state as pure step functions: inventories, sessions and replays, in batch and in streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GET = re.compile(r"^get (\d+) (.+)$")
_CRAFT = re.compile(r"^craft (\d+) (.+?) using (.+)$")
_PART = re.compile(r"^(\d+) (.+)$")


def craft_step(bag: dict[str, int], action: str, recipes: dict[str, list[tuple[int, dict[str, int]]]], goal: str | None) -> tuple[dict[str, int], str, float, bool]:
    """Inventory after one action, the observation, the reward and whether the goal is met.  Failures are text, never errors."""
    bag = dict(bag)
    action = " ".join((action or "").lower().split())
    if action == "inventory":
        held = " ".join(f"[{k}] ({v})" for k, v in sorted(bag.items()) if v)
        return bag, "Inventory: " + (held or "You are not carrying anything."), 0.0, False
    if m := _GET.match(action):
        n, item = int(m[1]), m[2]
        if item in recipes or n < 1:
            return bag, f"Could not find {item}", 0.0, False
        bag[item] = bag.get(item, 0) + n
        return bag, f"Got {n} {item}", float(item == goal), item == goal
    if m := _CRAFT.match(action):
        n, item = int(m[1]), m[2]
        parts = [_PART.match(p.strip()) for p in m[3].split(",")]
        if not all(parts):
            return bag, f"Could not execute {action}", 0.0, False
        given: dict[str, int] = {}
        for p in parts:
            given[p[2]] = given.get(p[2], 0) + int(p[1])
        if (n, given) not in recipes.get(item, []):
            return bag, f"Could not find a valid recipe for {item}", 0.0, False
        if any(bag.get(k, 0) < v for k, v in given.items()):
            return bag, f"Could not find enough items to craft {item}", 0.0, False
        for k, v in given.items():
            bag[k] -= v
        bag[item] = bag.get(item, 0) + n
        return bag, f"Crafted {n} {item}", float(item == goal), item == goal
    return bag, f"Could not execute {action}", 0.0, False


def observation_kind(c: Column) -> Column:
    return F.when(c.startswith("Got "), "got").when(c.startswith("Crafted "), "crafted").when(c.startswith("Inventory:"), "inventory").when(c.startswith("Could not find enough"), "missing_items").when(c.startswith("Could not find"), "not_found").when(c.startswith("Could not execute"), "not_executed").otherwise("other")


def fold_sessions(df: DataFrame, key: str, order: str, inputs: list[str], schema: str, start, step, show) -> DataFrame:
    """A row for each event of a keyed session, in order: ``show(state)`` after ``state = step(state, *inputs)``; a session starts as ``start(first row's inputs)``.

    A session is one group: it is what one worker plays, a few dozen events.
    """
    from trajecta.ship import ship

    ship(df.sparkSession)
    fields = df.select(key, order).schema
    for f in T._parse_datatype_string(schema).fields:
        fields = fields.add(f)
    names = [f.name for f in fields.fields]

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        state, out = None, []
        for k, o, *args in zip(*(pdf[c].tolist() for c in (key, order, *inputs)), strict=True):
            state = step(start(*args) if state is None else state, *args)
            out.append((k, o, *show(state)))
        return pd.DataFrame(out, columns=names)

    return df.select(key, order, *inputs).groupBy(key).applyInPandas(play, fields)


def run_sessions(actions: DataFrame, recipes: dict, key: str = "session", order: str = "step", action: str = "action", goal: str = "goal") -> DataFrame:
    """(session, step, observation, reward, done) for every action in order; after the goal the session stays done."""

    def step(state, act, want):
        bag, _, _, done = state
        return (bag, "Session is over", 0.0, True) if done else craft_step(bag, act, recipes, want)

    return fold_sessions(actions, key, order, [action, goal], "observation string, reward double, done boolean", lambda *_: ({}, "", 0.0, False), step, lambda s: s[1:])


def episode_step(state: dict, event: str, n_calls: int, n_tokens: int, stop: bool, caps: dict) -> dict:
    """An agent's episode after one event: pending, generating, tools, interacting or terminated.

    "start" begins it; "generated" adds a turn and its tokens and goes on to the
    tools it calls, to the interaction where there is one, or ends; "tools" and
    "reply" go back to generating.  Full caps (assistant_turns, user_turns,
    tokens) and a reply that stops end it; an event that doesn't fit changes nothing.
    """
    s = dict(state)
    at = s["state"]
    if at == "pending" and event == "start":
        s["state"] = "generating"
    elif at == "generating" and event == "generated":
        s["assistant_turns"] += 1
        s["tokens"] += n_tokens
        full = s["tokens"] >= caps["tokens"] or s["assistant_turns"] >= caps["assistant_turns"] or s["user_turns"] >= caps["user_turns"]
        s["state"] = "terminated" if full else "tools" if n_calls else "interacting" if caps.get("interaction") else "terminated"
    elif at == "tools" and event == "tools":
        s["tokens"] += n_tokens
        s["user_turns"] += 1
        s["state"] = "terminated" if s["tokens"] >= caps["tokens"] else "generating"
    elif at == "interacting" and event == "reply":
        s["tokens"] += n_tokens
        s["user_turns"] += 1
        s["state"] = "terminated" if stop or s["tokens"] >= caps["tokens"] else "generating"
    return s


def run_episodes(events: DataFrame, caps: dict, key: str, order: str, event: str, calls: str, tokens: str, stop: str) -> DataFrame:
    """(key, order, state, assistant_turns, user_turns, tokens) after each event of each episode."""
    start = {"state": "pending", "assistant_turns": 0, "user_turns": 0, "tokens": 0}
    return fold_sessions(events, key, order, [event, calls, tokens, stop], "state string, assistant_turns long, user_turns long, tokens long", lambda *_: start, lambda s, *a: episode_step(s, *a, caps), lambda s: (s["state"], s["assistant_turns"], s["user_turns"], s["tokens"]))


def replay_category(error: Column, expected: Column, seen: Column, feedback: Column) -> Column:
    """Verdict of a replay: error, unverifiable, mismatch, validated_parser_feedback or validated."""
    norm = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(error.isNotNull(), "error").when(expected.isNull(), "unverifiable").when(norm(expected) != norm(seen), "mismatch").when(feedback, "validated_parser_feedback").otherwise("validated")


def observation_fields(c: Column) -> Column:
    """map of the first line after each known prefix."""
    keys = ("Inventory:", "Got", "Crafted")
    pairs = [F.struct(F.lit(k.rstrip(":").lower()).alias("k"), F.trim(F.regexp_extract(c, rf"(?m)^{k}\s*(.*)$", 1)).alias("v")) for k in keys]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"] != ""))


def shared_fields(a: Column, b: Column) -> tuple[Column, Column]:
    """Keys of both maps whose values agree, and those whose values differ."""
    both = F.array_sort(F.array_intersect(F.map_keys(a), F.map_keys(b)))
    return F.filter(both, lambda k: F.element_at(a, k) == F.element_at(b, k)), F.filter(both, lambda k: F.element_at(a, k) != F.element_at(b, k))


class Slots:
    """So many places for calls at a time inside one worker; ``with`` waits for a free one, and gives it back after an error too."""

    def __init__(self, n: int):
        import threading

        self.n, self.free = n, threading.BoundedSemaphore(n)

    def __enter__(self):
        self.free.acquire()
        return self

    def __exit__(self, *_):
        self.free.release()


def with_retries(call, tries: int = 3, wait: float = 0.05):
    """``call`` tried again after an error, each time after twice the wait; the last error is raised."""

    def run(*args):
        import time

        for t in range(tries):
            try:
                return call(*args)
            except Exception:
                if t + 1 == tries:
                    raise
                time.sleep(wait * 2**t)

    return run


def batched_calls(df: DataFrame, call, schema: str, size: int = 64, tries: int = 3, at_once: int = 1) -> DataFrame:
    """Rows through an outside service: ``call(list of row dicts) -> list of row dicts``, batched in each partition, ``at_once`` calls in flight, and retried.

    Batches come back in order.  The last failure is raised, so Spark's task
    retry takes over.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        slots, sure = Slots(at_once), with_retries(call, tries)

        def one(rows):
            with slots:
                return sure(rows)

        with ThreadPoolExecutor(at_once) as pool:
            for pdf in parts:
                rows = pdf.to_dict("records")
                for got in pool.map(one, [rows[k : k + size] for k in range(0, len(rows), size)]):
                    yield pd.DataFrame(got)

    return df.mapInPandas(run, schema)


def passages(results: Column) -> Column:
    """Search results (array of struct(title, text)) as numbered passages for a prompt; none give an empty text."""
    return F.array_join(F.transform(results, lambda r, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.coalesce(r["title"], F.lit("")), F.lit(") "), F.coalesce(r["text"], F.lit("")))), "\n")
