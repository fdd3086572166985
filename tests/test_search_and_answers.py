"""The full-text index, maths answers by identity, pages by a stack of tags, parsers by source, nearest spans in long keys."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from trajecta.functions import actions as A
from trajecta.functions import algebra as AL
from trajecta.functions import pages as P
from trajecta.functions import text as X
from trajecta.operators import catalog, cuts, fulltext


def skewed_docs(r, n):
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, "common " * r.randint(0, 3) + " ".join(r.choices(vocabulary, weights, k=r.randint(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("block", [4, 128])
def test_index_gives_the_rows_of_a_full_search(spark, tmp_path, block):
    r = random.Random(3)
    docs = spark.createDataFrame([*skewed_docs(r, 500), (900, None), (901, "")], "id long, text string")
    asked = [(i, " ".join(r.choices(["common", "w0", "w1", "w5", "w80", "w299", "absent"], k=r.randint(1, 4)))) for i in range(25)] + [(98, "absent"), (99, None)]
    queries = spark.createDataFrame(asked, "q long, words string")
    fulltext.write_index(docs, "id", "text", str(tmp_path / "ix"), block=block, buckets=3)
    for k in (1, 7, 600):
        got = fulltext.Index(spark, str(tmp_path / "ix")).search(queries, "q", "words", k).collect()
        want = catalog.bm25(docs, queries.withColumnRenamed("words", "text"), "id", "q", "text", k).collect()
        assert sorted((x.q, x.doc, x.score, x["rank"]) for x in got) == sorted((x.q, x.id, x.score, x["rank"]) for x in want)


def test_index_reads_few_blocks(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "common " + " ".join(r.choices(["x", "y", "z"], k=r.randint(1, 60)))) for i in range(4000)] + [(5000 + i, "common rare") for i in range(5)]
    fulltext.write_index(spark.createDataFrame(rows, "id long, text string"), "id", "text", str(tmp_path / "ix"), block=16, buckets=2)
    index = fulltext.Index(spark, str(tmp_path / "ix"))
    sets = spark.createDataFrame([(["common", "rare"], t) for t in ("common", "rare")], "terms array<string>, term string")
    found = index.plan(sets, 5)
    total = index.blocks.where(F.col("term").isin("common", "rare")).agg(F.sum("n")).first()[0]
    read = sum(found[x].join(index.blocks, ["bucket", "term", "tier", "block"]).agg(F.sum("n")).first()[0] or 0 for x in ("needed", "probes"))
    assert total > 4000 and read < total / 5
    assert {x.doc for x in found["scores"].orderBy(F.desc("score")).limit(5).collect()} == {5000 + i for i in range(5)}


SAME = [("x^2-1", "(x-1)(x+1)"), ("\\frac{\\sqrt{2}}{2}", "\\frac{1}{\\sqrt{2}}"), ("\\sqrt2\\sqrt3", "\\sqrt{6}"), ("sqrt(-4)", "2\\sqrt{-1}"), ("\\sqrt[3]{16}", "2\\sqrt[3]{2}"), ("2^{x+1}", "2*2^x"), ("4^{1/2}", "2"), ("x/x", "1"), ("|-3|", "3"), ("-2^2", "-4"), ("log(8)", "log(2^3)"), ("\\frac12x", "\\frac{x}{2}"), ("12345678910111213^2", "12345678910111213*12345678910111213"), ("1.5", "\\frac{3}{2}")]
OTHER = [("(x+1)^3", "x^3+3x^2+3x"), ("-x^2", "x^2"), ("x", "y"), ("\\sin x", "\\cos x"), ("\\sqrt{2}", "1.41421356237"), ("10^{40}", "10^{40}+1")]


def test_identity_of_expressions():
    assert all(AL.identical(a, b) for a, b in SAME) and not any(AL.identical(a, b) for a, b in OTHER)
    for bad in ("((((", "", "x &", "\\text{no}", "(" * 3000, "1/0"):
        with pytest.raises(ValueError):
            AL.identical(bad, "1")
    with pytest.raises(AL.Unknown):
        AL.identical("9^9^9^9", "1")


def test_identity_on_random_rewritings():
    r = random.Random(7)

    def tree(d):
        return r.choice([str(r.randint(1, 9)), "x", "y"]) if d == 0 else f"({tree(d - 1)}{r.choice('+-*')}{tree(d - 1)})"

    for _ in range(150):
        a, b, c = tree(2), tree(2), tree(1)
        assert AL.identical(f"({a})({b}+{c})", f"{a}*{b}+{c}*{a}")
        assert AL.identical(f"({a}-{b})^2", f"{a}^2-2{a}{b}+{b}^2")
        assert not AL.identical(f"{a}+{b}", f"{a}+{b}+\\frac{{1}}{{{10**9}}}")


GRADES = [("2/4", "1/2", True, False), ("5.0", "5", True, True), ("5.0001", "5", True, False), ("50%", "0.5", True, False), ("3\\pi", "9.42", True, False), ("3\\pi", "9.4248", True, False), ("3\\pi", "9.5", False, False), ("7 3/4", "31/4", True, True), ("(1, x+x)", "(1, 2x)", True, True), ("(1, 2)", "[1, 2]", False, False), ("(1,2,3)", "(1,2)", False, False), (None, "1", False, False), ("", "1", False, False), ("yes", "yes", True, True)]


def test_grades(spark):
    for a, b, loose, strict in GRADES:
        assert (AL.graded(a, b), AL.graded(a, b, True)) == (loose, strict), (a, b)
    loose, boxed = AL.grade_columns()
    df = spark.createDataFrame([(a, b) for a, b, *_ in GRADES], "a string, b string")
    assert [x[0] for x in df.select(loose("a", "b")).collect()] == [g[2] for g in GRADES]
    assert df.limit(1).select(boxed(F.lit("so \\boxed{x+x}"), F.lit("2x"))).first()[0] is True


class Events(HTMLParser):
    """An event-driven reader of the same texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.open = [], [], False

    def handle_starttag(self, tag, attrs):
        self.open = False
        if tag not in P.VOID:
            self.stack.append((tag, dict(attrs).get("class") or ""))

    def handle_startendtag(self, tag, attrs):
        self.open = False

    def handle_comment(self, data):
        self.open = False

    handle_decl = handle_comment

    def handle_endtag(self, tag):
        self.open = False
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] not in P.HIDDEN:
            if self.open:
                self.out[-1][0] += data
            else:
                self.out.append([data, *self.stack[-1]])
            self.open = True


def read_events(html):
    p = Events()
    p.feed(html)
    p.close()
    return [tuple(x) for x in p.out if x[0] != "\n"]


def test_page_nodes_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = pages.select("html", P.page_nodes(F.col("html")).alias("n")).collect()
    assert len(got) == pages.count()
    for x in got:
        assert [(n["text"], n["tag"], n["class"]) for n in x.n] == read_events(x.html)


@pytest.mark.parametrize("run", [2, 128])
def test_page_nodes_of_odd_pages(spark, monkeypatch, run):
    monkeypatch.setattr(P, "RUN", run)
    odd = ["<div>a<p>b</div>c</p>d", "<div>x < y && y > z</div>", "text outside", "", "<p class='a b'>t</p>", "<P CLASS=q>t<BR>u</P>", "<div title='a>b'>t</div>", "<div><script>if (a<b) {'</p>'}</script>t<!-- <p>no</p> -->u</div>", "<div>\n<b>\n</b> \n</div>", "<div>&lt;b&gt; &amp;amp; &copy;&#233;&#x1F600;&nope; &eacute; a&b &#;</div>", "<div>" + "<i>x</i>" * 400 + "</div>", "</b></i><u>t", "<title>x</title><button>y</button>"]
    got = [[(n["text"], n["tag"], n["class"]) for n in x.n] if x.n is not None else None for x in spark.createDataFrame([(h,) for h in [*odd, None]], "h string").select(P.page_nodes(F.col("h")).alias("n")).collect()]
    assert got[-1] is None
    for h, mine in zip(odd, got, strict=False):
        assert mine == read_events(h), h


def test_action_lines_as_the_pattern_says(spark):
    got = spark.createDataFrame([("Action:\r\nget 1 log",), ("Action: a\rb\nc",), ("Action:\x0b x",), ("Action:",), ("x\nAction: y\n",), (None,)], "t string").select(X.action_lines(F.col("t"))).collect()
    assert [x[0] for x in got] == [["get 1 log"], ["a\rb"], ["x"], [""], ["y"], None]


def test_parsers_stand_under_the_sources_of_rows(spark):
    assert set(A.PARSERS) == {"textcraft", "sciworld", "alfworld", "babyai", "searchqa", "webshop"}
    df = spark.createDataFrame([("textcraft", "Action: get 1 log"), ("webshop", "Action: click[Buy]"), ("other", "Action: x")], "s string, t string")
    assert [x[0] for x in df.select(A.action_for(F.col("s"), F.col("t"))).collect()] == ["get 1 log", "click[Buy]", None]


def plain_nearest(p, spans, policy):
    held = [(s, n) for s, e, n in spans if s <= p < e]
    if held:
        return min(held)[1], "contained", 0
    before, after = [x for x in spans if x[1] <= p], [x for x in spans if x[0] >= p]
    if policy == "previous":
        if before:
            s, e, n = max(before)
            return n, "previous", p - e + 1
        return (min(after)[2], "first", min(after)[0] - p) if after else (None, None, None)
    near = [(p - e + 1, n) for s, e, n in before] + [(s - p, n) for s, e, n in after]
    return (min(near)[1], "nearest", min(near)[0]) if near else (None, None, None)


@pytest.mark.parametrize("policy", ["previous", "nearest"])
def test_nearest_spans_of_one_long_key(spark, policy):
    r = random.Random(11)
    spans = [(k, s, s + r.randint(1, 30), i) for i, (k, s) in enumerate((r.choice([1, 1, 1, 2]), r.randint(0, 3000)) for _ in range(60))]
    points = [(k, p) for k in (1, 2, 3) for p in r.sample(range(3100), 200)]
    got = cuts.nearest_span(spark.createDataFrame(points, "k long, p long"), spark.createDataFrame(spans, "k long, s long, e long, n long"), "k", "p", "s", "e", "n", policy).collect()
    assert len(got) == len(points)
    for x in got:
        assert (x.span, x.policy, x.distance) == plain_nearest(x.p, [s[1:] for s in spans if s[0] == x.k], policy)


def test_nearest_spans_take_time_in_proportion(spark):
    took = {}
    for n in (1_000, 100_000):
        points = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("p"))
        spans = spark.range(n // 10).select(F.lit(1).alias("k"), (F.col("id") * 100 + 3).alias("s"), (F.col("id") * 100 + 5).alias("e"), F.col("id").alias("n"))
        t = time.time()
        assert cuts.nearest_span(points, spans, "k", "p", "s", "e", "n").where("span is not null").count() == n
        took[n] = time.time() - t
    assert took[100_000] < 20 * max(took[1_000], 1)
