"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

Hidden states are a role and whether the line begins a turn or goes on with
it.  Lines are observed by their speaker marker, by what stands before them (a
blank line, the end of a sentence, or neither) and by their shape: length, last
character and first word.  Rows only carry lines: where a row begins or ends is
never looked at.  A marker always begins a turn.  Viterbi gives the best states.

The odds are counted on the table's marked lines, on top of fixed prior counts:
how first lines look, and, between two markers of roles that follow one another,
how the lines of a turn look and how many there are.

A conversation may be of any length: all rows are sorted by range partitions
and dealt into blocks of at most ``BLOCK_TURNS`` rows.  A block's best scores
from each entry state to each exit state form a small max-plus matrix.  The
matrices of a partition are multiplied, those of a conversation's partitions
give the states at their borders, those of a partition's blocks the states in
between, and the blocks are then decoded one by one.  A block knows how the line
before it ends, so the result doesn't depend on where it begins.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajecta.llm.tables import cut
from trajecta.ship import ship

ROLES = ("system", "user", "assistant")
BLOCK_TURNS = 1024
# Speaker words of each role.
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "sys"),
    "user": ("user", "human", "customer", "question", "q", "prompt"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "agent"),
}
_NAME = {n: r for r, names in SPEAKERS.items() for n in names}
_MARK = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*|>\s*)?(" + "|".join(sorted(_NAME, key=len, reverse=True)) + r")(?:\|>|\]|\*\*:?|:\*\*|\s*(?:[:>]|-(?=\s|$)))\s*", re.IGNORECASE)
_END = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>)\s*$")

_WORD = re.compile(r"[^\W\d_]+")

# States 2 * role (begins a turn) and 2 * role + 1 (goes on).
STATES = 2 * len(ROLES)
HOW = ("blank", "ended", "other")
# First words that ask or greet.
ASKS = ("who", "what", "when", "where", "why", "how", "which", "can", "could", "would", "please", "is", "are", "do", "does")
GREETS = ("hi", "hello", "hey", "thanks", "thank", "sure", "yes", "no", "ok", "okay", "sorry", "certainly")
#: Shape of a line: its length (powers of two), how it ends, how it starts.
LENGTHS, ENDS, OPENS = 14, ("empty", "bare", "stop", "question", "loud", "other"), ("asks", "greets", "word", "other")
SHAPES = LENGTHS + len(ENDS) + len(OPENS)
# Prior odds of the role of the next turn after each role, of what stands before a line where a turn begins
# and within one, of going on, and of a marker where a turn begins: one turn in eight has none, few have another role's,
# and a marked line within a turn is all but ruled out.
NEXT = {"system": (0.02, 0.88, 0.10), "user": (0.02, 0.08, 0.90), "assistant": (0.01, 0.93, 0.06)}
BEGINS, GOES_ON, STAY = (0.55, 0.40, 0.05), (0.07, 0.40, 0.53), 0.7
NONE, OWN, OTHER, WITHIN = 0.125, 0.875, 1e-5, 1e-12
#: Lines that the prior odds count for, and lines for each value of a shape.
PRIOR, SHAPE_PRIOR = 200.0, 20.0

# Counts of a table, one after the other: what stands before marked lines and before lines within turns, next roles,
# turns and further lines of each role, shapes of both for each role.
_R = len(ROLES)
_PARTS = {"begins": (len(HOW),), "within": (len(HOW),), "next": (_R, _R), "turns": (_R,), "more": (_R,), "first": (_R, SHAPES), "later": (_R, SHAPES)}


def no_counts() -> dict[str, np.ndarray]:
    return {k: np.zeros(v) for k, v in _PARTS.items()}


class Odds:
    """Log odds of the model: ``move`` between states, ``start`` of a conversation, and of a line: what is before it, its marker, its shape."""

    def __init__(self, counts: dict[str, np.ndarray] | None = None):
        c = counts or no_counts()
        # a marker after one of the same role may hide an unmarked turn: such pairs keep their prior odds
        own = np.array([NEXT[r][k] for k, r in enumerate(ROLES)])
        nxt = PRIOR * np.array([NEXT[r] for r in ROLES]) + c["next"]
        np.fill_diagonal(nxt, 0.0)
        nxt = nxt / nxt.sum(1, keepdims=True) * (1 - own)[:, None] + np.diag(own)
        stay = (PRIOR * STAY + c["more"]) / (PRIOR + c["more"] + c["turns"])
        self.move = np.full((STATES, STATES), -np.inf)
        for r in range(_R):
            for s in (2 * r, 2 * r + 1):
                self.move[s, 2 * r + 1] = np.log(stay[r])
                self.move[s, ::2] = np.log((1 - stay[r]) * nxt[r])
        self.start = np.log(np.array([0.25, 1e-4, 0.65, 1e-4, 0.1, 1e-4]))
        first, within = PRIOR * np.array(BEGINS) + c["begins"], PRIOR * np.array(GOES_ON) + c["within"]
        how = np.log([first / first.sum(), within / within.sum()]).T
        self.how = np.tile(how, _R)
        self.mark = np.log([[x for name in ROLES for x in ((NONE, 1.0) if role is None else (OWN if role == name else OTHER, WITHIN))] for role in (None, *ROLES)])
        prior = np.full(SHAPES, SHAPE_PRIOR)
        shape = np.empty((SHAPES, STATES))
        for r in range(_R):
            for k, part in enumerate(("first", "later")):
                x = prior + c[part][r]
                if k == 0:
                    x[LENGTHS] = 0.01 * SHAPE_PRIOR  # an empty line without a marker hardly begins a turn
                for at, n in ((0, LENGTHS), (LENGTHS, len(ENDS)), (LENGTHS + len(ENDS), len(OPENS))):
                    shape[at : at + n, 2 * r + k] = np.log(x[at : at + n] / x[at : at + n].sum())
        self.shape = shape


PLAIN = Odds()
MOVE, START = PLAIN.move, PLAIN.start


def tail(line: str) -> str:
    """The last character of a line, white space aside: all that the next line needs of it."""
    return line.rstrip()[-1:]


def shape(text: str, marked: bool) -> tuple[int, int, int]:
    """Places of a line's length, end and start among the ``SHAPES``."""
    end = tail(text)
    if not end:
        kind = 1 if marked else 0
    else:
        kind = 2 if end in ".。" else 3 if end in "?？" else 4 if end in "!:" else 5
    m = _WORD.match(text.lstrip())
    word = m[0].lower() if m else ""
    start = 0 if word in ASKS else 1 if word in GREETS else 2 if word else 3
    return min(len(text).bit_length(), LENGTHS - 1), LENGTHS + kind, LENGTHS + len(ENDS) + start


def features(line: str, before: str | None) -> tuple[int | None, str | None, str]:
    """What stands before the line (place in ``HOW``; null at the start of a conversation), the role that its marker names, and the line without its marker."""
    m = _MARK.match(line)
    role = _NAME[m[1].lower()] if m else None
    text = _END.sub("", line[m.end() :] if m else line)
    if before is None:
        return None, role, text
    end = tail(before)
    return (0 if not end else 1 if end in ".!?>:" else 2), role, text


def emissions(lines: list[str], before: str | None, odds: Odds = PLAIN) -> tuple[np.ndarray, list[str]]:
    """Log odds of all lines in each state, and the lines without markers."""
    out, texts = np.zeros((len(lines), STATES)), []
    for i, line in enumerate(lines):
        how, role, text = features(line, before)
        out[i] = odds.mark[0 if role is None else ROLES.index(role) + 1] + odds.shape[list(shape(text, role is not None))].sum(0)
        if how is not None:
            out[i] += odds.how[how]
        texts.append(text)
        before = line
    return out, texts


def times(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (m[:, :, None] + n[None]).max(1)


def transfer(e: np.ndarray, odds: Odds = PLAIN) -> np.ndarray:
    """Best score from each state before the lines to each state of the last line."""
    m = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(m, 0.0)
    for row in e:
        m = times(m, odds.move) + row[None]
    return m


def viterbi(e: np.ndarray, entry: int | None, leave: int | None, odds: Odds = PLAIN) -> list[int]:
    """Best states of the lines (ties: lower state), with the states at the borders given or free."""
    if not len(e):
        return []
    score = (odds.start if entry is None else odds.move[entry]) + e[0]
    back = []
    for row in e[1:]:
        step = score[:, None] + odds.move
        back.append(step.argmax(0))
        score = step.max(0) + row
    s = int(score.argmax()) if leave is None else leave
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


def borders(first: np.ndarray, rest: list[np.ndarray], leave: int | None = None) -> list[int]:
    """States at the ends of blocks: ``first`` scores the first block's ends, ``rest`` are transfer matrices; the last end is given or free."""
    score, back = first, []
    for m in rest:
        step = score[:, None] + m
        back.append(step.argmax(0))
        score = step.max(0)
    s = int(score.argmax()) if leave is None else leave
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


def render(role: str, content: str) -> str:
    return f"<|{role}|>\n{content}\n<|end|>\n"


def turns(states: list[int], texts: list[str]) -> list[tuple[str, str]]:
    """(role, content) of the parsed turns."""
    out: list[tuple[str, list[str]]] = []
    for s, t in zip(states, texts, strict=True):
        if s % 2 == 0 or not out:
            out.append((ROLES[s // 2], [t]))
        else:
            out[-1][1].append(t)
    return [(r, "\n".join(x).strip()) for r, x in out]


def parse(transcript: str) -> list[tuple[str, str]]:
    """Turns of one transcript at once (the plain form, for short transcripts and tests)."""
    if not transcript:
        return []
    e, texts = emissions(transcript.split("\n"), None)
    return turns(viterbi(e, None, None), texts)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with __tj_pid, __tj_blk, __tj_seq and __tj_before (how the line before the block ends): sorted ranges of (conv_id, turn, raw), cut into blocks.

    Ranges split a conversation of any size, and rows that are equal in all
    three as well.
    """
    import pyarrow as pa

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "raw", "__tj_tie"]
    sorted_rows = rows.withColumn("__tj_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tj_tie").withColumn("__tj_pid", F.spark_partition_id())
    more = T._parse_datatype_string("__tj_blk long, __tj_seq long, __tj_before string, __tj_tail string").fields
    c, r = rows.columns.index("conv_id"), rows.columns.index("raw")

    def run(batches):
        blk, n, conv, before, seq = 0, 0, None, None, 0
        for b in batches:
            out = []
            for own, raw in zip(b.column(c).to_pylist(), b.column(r).to_pylist(), strict=True):
                if seq and own != conv:
                    blk, n, before = blk + 1, 0, None
                elif n == BLOCK_TURNS:
                    blk, n = blk + 1, 0
                end = tail(raw.rsplit("\n", 1)[-1])
                out.append((blk, seq, before if n == 0 else None, end))
                conv, before, n, seq = own, end, n + 1, seq + 1
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[*b.schema.names, *(f.name for f in more)])

    dealt = cut(sorted_rows.mapInArrow(run, T.StructType([*sorted_rows.schema.fields, *more])))
    # how the partition before ends, if with the same conversation: a row for each partition
    last = dealt.groupBy("__tj_pid").agg(F.max_by(F.struct("conv_id", "__tj_tail"), "__tj_seq").alias("x"))
    last = last.select(F.col("__tj_pid").alias("__tj_p"), F.lag("x").over(Window.orderBy("__tj_pid")).alias("x")).where("x is not null")
    near = (dealt["__tj_pid"] == last["__tj_p"]) & (dealt["__tj_seq"] == 0) & dealt["conv_id"].eqNullSafe(last["x.conv_id"])
    out = dealt.join(F.broadcast(last), near, "left").withColumn("__tj_before", F.coalesce("__tj_before", "x.__tj_tail"))
    return out.drop("__tj_p", "x", "__tj_tail")


def count_lines(rows, found: dict[str, np.ndarray]) -> None:
    """Adds what the marked lines of ``rows`` (conversation, partition, place, text; in order) tell to the counts ``found``.

    All lines between two markers are the first one's turn if the second role
    is the one that mostly follows; else an unmarked turn may hide there.
    """
    at = before = role = None
    held, n = no_counts(), 0
    for conv, pid, seq, raw in rows:
        if at != (conv, pid, seq - 1):
            before = role = None
        at = (conv, pid, seq)
        for line in raw.split("\n"):
            how, own, text = features(line, before)
            before = line
            marks = list(shape(text, own is not None))
            if own is not None:
                k = ROLES.index(own)
                if role is not None:
                    found["next"][role, k] += 1
                    if NEXT[ROLES[role]][k] > 0.5:
                        found["turns"][role] += 1
                        found["more"][role] += n
                        found["within"] += held["within"]
                        found["later"][role] += held["later"][role]
                role, held, n = k, no_counts(), 0
                found["first"][k, marks] += 1
                if how is not None:
                    found["begins"][how] += 1
            elif role is not None:
                n += 1
                held["within"][how] += 1
                # the blank lines before the next turn count as lines of this one
                held["later"][role, marks] += 1


def _counts(base: DataFrame) -> Odds:
    """The model with the marked lines of all rows counted: a few sums, whatever the size of the table."""
    import pyarrow as pa

    def run(batches):
        found = no_counts()
        count_lines((x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)), found)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.ravel() for v in found.values()]).tolist()], pa.list_(pa.float64()))], names=["x"])

    got = base.select("conv_id", "__tj_pid", "__tj_seq", "raw").mapInArrow(run, "x array<double>")
    cells = {x["k"]: x["x"] for x in got.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()}  # a row for each count of the model
    found, at = no_counts(), 0
    for v in found.values():
        v.flat = [cells.get(at + i, 0.0) for i in range(v.size)]
        at += v.size
    return Odds(found)


def parse_blocks(rows: DataFrame, fit: bool = True) -> DataFrame:
    """``rows`` (conv_id, turn, line text ``raw``, and more) with n_lines, n_turns, parsed_role, begins and rendered for ``raw``.

    A row's lines are consecutive lines of its conversation, in the order of
    turn (then of the text, for repeated turns); the parse is of lines alone and
    the same however they are dealt into rows.  parsed_role is the role of the
    row's first line, and begins says whether a turn begins there; rendered has the turns that its lines hold, where lines
    that go on with an earlier turn carry that turn's role.  Of equally likely
    states the lower counts.  ``fit`` counts the odds on the marked lines.

    Null text is one empty line, and very long texts are parsed whole.  Rows
    with a null conv_id are one conversation, and null turns come first.  Each
    row gives one row, repeated ones too, and an empty table none.  Columns
    named like a result are replaced, others pass through.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ship(rows.sparkSession)
    made = ["n_lines", "n_turns", "parsed_role", "begins", "rendered"]
    pass_on = [f for f in rows.schema.fields if f.name not in ("conv_id", "turn", "raw", *made)]
    base = _blocks(rows.select("conv_id", "turn", F.coalesce("raw", F.lit("")).alias("raw"), *(rows[f.name] for f in pass_on)))
    odds = _counts(base) if fit else PLAIN
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv, to_conv = rows.schema["conv_id"], to_arrow_type(rows.schema["conv_id"].dataType)

    def groups(batches):
        """Rows of one block after the other: (pid, blk, before, raw, ...)."""
        held, key = [], None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:2] != key and held:
                    yield held
                    held = []
                key = row[:2]
                held.append(row)
        if held:
            yield held

    def seen(held):
        return emissions([x for row in held for x in row[3].split("\n")], held[0][2], odds)

    def dealt(df):
        return df.repartition(parts, "__tj_pid", "__tj_blk").sortWithinPartitions("__tj_pid", "__tj_blk", "__tj_seq")

    def measure(batches):
        for held in groups(batches):
            e, _ = seen(held)
            body = transfer(e[1:], odds)
            head = (odds.start + e[0])[:, None] + body
            whole = times(odds.move + e[0][None], body)
            yield pa.RecordBatch.from_arrays([pa.array([held[0][4]], to_conv), pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([head.max(0).tolist()], pa.list_(pa.float64())), pa.array([whole.ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "pid", "blk", "first", "matrix"])

    lists = "first array<double>, matrix array<double>"
    one = dealt(base.select("__tj_pid", "__tj_blk", "__tj_before", "raw", "conv_id", "__tj_seq")).mapInArrow(measure, T.StructType([conv, *T._parse_datatype_string(f"pid int, blk long, {lists}").fields]))
    one = cut(one)
    # a partition has a bounded number of a conversation's blocks, and a conversation at most one chain in each partition
    within = one.groupBy("conv_id", "pid").agg(F.sort_array(F.collect_list(F.struct("blk", "first", "matrix"))).alias("chain"))

    def square(x):
        return np.array(x).reshape(STATES, STATES)

    def product(batches):
        for b in batches:
            out = []
            for c, pid, chain in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                first, m = np.array(chain[0]["first"]), square(chain[0]["matrix"])
                for x in chain[1:]:
                    n = square(x["matrix"])
                    first, m = (first[:, None] + n).max(0), times(m, n)
                out.append((c, pid, first.tolist(), m.ravel().tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (to_conv, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["conv_id", "pid", "first", "matrix"])

    across = within.mapInArrow(product, T.StructType([conv, *T._parse_datatype_string(f"pid int, {lists}").fields]))
    across = across.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pid", "first", "matrix"))).alias("chain"))

    def outer(batches):
        for b in batches:
            out = []
            for c, chain in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends = borders(np.array(chain[0]["first"]), [square(x["matrix"]) for x in chain[1:]])
                out += [(c, x["pid"], ends[i - 1] if i else -1, ends[i]) for i, x in enumerate(chain)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (to_conv, pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["c", "p", "entry", "leave"])

    ends = across.mapInArrow(outer, T.StructType([T.StructField("c", conv.dataType), *T._parse_datatype_string("p int, entry int, leave int").fields]))
    both = within.join(ends, within.conv_id.eqNullSafe(ends.c) & (within.pid == ends.p)).select("pid", "chain", "entry", "leave")

    def inner(batches):
        for b in batches:
            out = []
            for pid, chain, entry, leave in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                head = np.array(chain[0]["first"]) if entry < 0 else square(chain[0]["matrix"])[entry]
                states = borders(head, [square(x["matrix"]) for x in chain[1:]], leave)
                out += [(pid, x["blk"], states[i - 1] if i else entry, states[i]) for i, x in enumerate(chain)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["p", "k", "entry", "leave"])

    ends = both.mapInArrow(inner, "p int, k long, entry int, leave int")
    full = base.join(ends, (base["__tj_pid"] == ends.p) & (base["__tj_blk"] == ends.k))
    full = dealt(full.select("__tj_pid", "__tj_blk", "__tj_before", "raw", "entry", "leave", "conv_id", "turn", *(f.name for f in pass_on), "__tj_seq"))
    keep = [conv, rows.schema["turn"], *pass_on]
    schema = T.StructType([*keep, *T._parse_datatype_string("n_lines long, n_turns long, parsed_role string, begins boolean, rendered string").fields])
    kinds = [*(to_arrow_type(f.dataType) for f in keep), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

    def decode(batches):
        for held in groups(batches):
            e, texts = seen(held)
            entry, leave = held[0][4:6]
            states = viterbi(e, None if entry < 0 else entry, leave, odds)
            at, out = 0, []
            for row in held:
                n = row[3].count("\n") + 1
                own = states[at : at + n]
                said = turns(own, texts[at : at + n])
                out.append((*row[6:-1], n, sum(1 for s in own if s % 2 == 0), ROLES[own[0] // 2], own[0] % 2 == 0, "".join(render(r, c) for r, c in said)))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return full.mapInArrow(decode, schema)


def as_transcript(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, raw, role, layout, marked): conversations as transcripts in one of five styles by hash; one turn in eight loses its marker.

    layout says what stands between turns, by hash too: "newline", the next turn
    on the next line, or "blank", a blank line first.

    A null role is written as a user's, a null text as an empty one; a null turn
    keeps its marker.  Each row gives one row, repeated ones too, and an empty
    table none; very long texts are kept whole and other columns are not read.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    role = F.coalesce("role", F.lit("user"))
    name = F.when(role == "user", F.element_at(F.array(*map(F.lit, ("User", "Human", "Q", "user", "Customer"))), (style + 1).cast("int"))).when(role == "assistant", F.element_at(F.array(*map(F.lit, ("Assistant", "AI", "A", "assistant", "Agent"))), (style + 1).cast("int"))).otherwise(F.lit("System"))
    mark = F.when(style == 3, F.concat(F.lit("<|im_start|>"), name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": "))).when(style == 4, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(name, F.lit(": ")))
    marked = ~((F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0) & F.coalesce(F.col("turn") > 0, F.lit(False)))
    apart = F.pmod(F.xxhash64("conv_id", F.lit("layout")), F.lit(2)) == 0
    raw = F.concat(F.when(marked, mark).otherwise(F.lit("")), F.coalesce("text", F.lit("")), F.when(apart, F.lit("\n")).otherwise(F.lit("")))
    return conversations.select("conv_id", "turn", raw.alias("raw"), "role", F.when(apart, F.lit("blank")).otherwise(F.lit("newline")).alias("layout"), marked.alias("marked"))
