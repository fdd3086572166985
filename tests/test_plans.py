"""Every query against its SQL in DuckDB on the smallest tables."""

import datetime
import math
import re
import string

import duckdb
import pytest
from pyspark.sql import functions as F

from trajecta.functions.text import normalize_answer
from trajecta.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.ORACLES:
        assert got
        return
    res = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert got == want


#: The rows that are ASCII, where DuckDB's words and white space are those of the reference.
NORMAL = r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) normal from documents where strlen(text) = length(text)"


def plain_normal(t):
    t = "".join(c for c in t.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


def test_normalisation_of_all_texts(spark, sf, duck):
    got = {x.doc_id: x.normal for x in catalogue.QUERIES["answer_normalisation"](spark, sf).collect()}
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert any(not t.isascii() for t in texts.values())
    assert got == {k: plain_normal(t) for k, t in texts.items()}
    for k, t in duck.execute(NORMAL).fetchall():
        assert got[k] == t
    odd = ["\u00e9a th\u00e9 the\u00e9 an", "a\u0301 the\u093f a", "x\u00a0a\u00a0b\u2003the\u3000z", "\x1ca\x1d b\x85c", "\u3000 a ", "\u0130the \u03a3\u0391\u03a3", "a\u0660 the_a \u00aaa", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", normalize_answer(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: plain_normal(t) for i, t in enumerate(odd)}


def test_every_fiftieth_part_is_a_search(spark, sf, duck):
    got = catalogue.QUERIES["bm25_top"](spark, sf).collect()
    want = duck.execute("select p_partkey from part where p_partkey % 50 = 0 and regexp_matches(lower(p_name), '[a-z0-9]')").fetchall()
    assert len(want) > 1 and {x["query"] for x in got} == {k for k, in want}


def test_whole_tables_of_messages_and_summaries(spark, sf, duck):
    from trajecta.functions.text import plausible_last_line

    line = catalogue.QUERIES["plausible_action_line"](spark, sf).collect()
    assert len(line) == duck.execute("select count(*) from part").fetchone()[0]
    old = {x.k: x.old_rows for x in catalogue.QUERIES["summary_comparison"](spark, sf).collect() if x.old_rows is not None}
    assert old == dict(duck.execute("select o_orderstatus, count(*) from orders group by 1").fetchall())
    # lines to choose from, in the forms with thoughts, think tags and several actions
    texts = ["Thought: turn left?\nAction: get 1 drop!", "<think> go to\nmove </think> Action: [[ Check it ]]", "Action: move a\nAction: toggle b\nso", "<think>drop it</think> ok"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", plausible_last_line(F.col("t")).alias("l")).collect()
    assert {r.i: r.l for r in got} == {0: "action: get 1 drop!", 1: "action: [[ check it ]]", 2: "action: toggle b", 3: None}


def test_bootstrap_takes_a_thousand_draws(spark, sf):
    from trajecta.operators import metrics

    got = sorted(map(tuple, catalogue.QUERIES["bootstrap_best_worst"](spark, sf).collect()))
    want = sorted(map(tuple, metrics.bootstrap(spark.read.parquet(f"{sf}/events.parquet"), "event_type", "value", "event_id", 8, 1000).collect()))
    assert [x[0] for x in got] == [x[0] for x in want] and all(a == pytest.approx(b, rel=1e-9) for x, y in zip(got, want, strict=True) for a, b in zip(x[1:], y[1:], strict=True))


def test_bootstrap_against_plain_resampling(spark):
    import statistics

    from trajecta.operators import metrics

    values = {"a": [3.0, -1.0, 4.0, 1.5], "b": [7.0], "c": [float(i) for i in range(30)]}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)], "g string, i int, v double")
    got = {x.g: tuple(x)[1:] for x in metrics.bootstrap(df, "g", "v", "i", 5, 40, 7).collect()}
    hashes = spark.createDataFrame([(g, d, k) for g in values for d in range(40) for k in range(5)], "g string, d int, k int").select("g", "d", F.xxhash64(F.lit(7), "g", "d", "k").alias("h")).collect()
    for g, vs in values.items():
        drawn = [[vs[x.h % len(vs)] for x in hashes if x.g == g and x.d == d] for d in range(40)]
        best, worst = [max(x) for x in drawn], [min(x) for x in drawn]
        assert got[g] == pytest.approx((statistics.fmean(best), statistics.pstdev(best), statistics.fmean(worst), statistics.pstdev(worst)))


def test_mode_names():
    from trajecta.operators.prefixes import mode_name

    assert [mode_name(m) for m in (" Cont-Mean ", "cont_ mean _abs", "contstant")] == ["cont_mean", "cont_mean_abs", "constant"]
    with pytest.raises(ValueError):
        mode_name("family lift")
