"""Canonical JSON, spans, trimmed histories, reduced choices, part logs and table comparison."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trajecta.functions import variants as V
from trajecta.operators import compare as C
from trajecta.operators import messages as M
from trajecta.operators import shop as SH
from trajecta.sources.partlog import PartLog


def test_canonical_json(spark):
    r = random.Random(2)

    def value(d):
        kind = r.choice("nsblo" if d else "nsb")
        return {"n": r.randint(-5, 10**12), "s": r.choice(["", "a\"b\\", "é\n", "z"]), "b": r.choice([True, None]), "l": [value(d - 1) for _ in range(r.randint(0, 3))] if d else 0, "o": {r.choice("abcxyzé"): value(d - 1) for _ in range(r.randint(0, 4))} if d else 0}[kind]

    made = [value(4) for _ in range(80)]
    texts = [json.dumps(x, indent=r.choice([None, 1]), ensure_ascii=r.choice([True, False])) for x in made]
    rows = spark.createDataFrame([(t,) for t in [*texts, "{bad", '{"a":1,"a":2}', "", None]], "t string").select(V.canonical_json(F.col("t")).alias("c"), V.canonical_key(F.col("t")).alias("k")).collect()
    for x, y in zip(made, rows, strict=False):
        assert json.loads(y.c) == x and y.c == json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [y.c for y in rows[80:]] == ["{bad", '{"a":1,"a":2}', "", None]
    assert len({y.k for y in rows[:80]}) == len({y.c for y in rows[:80]})


def test_spans(spark):
    good = [('{"start":1,"end":4}', [(1, 4)]), ("[2, 2]", [(2, 2)]), ("[0.9, 3.2]", [(0, 3)]), ('[[1,2],{"end":9,"start":3}]', [(1, 2), (3, 9)]), ("[]", []), (None, [])]
    got = spark.createDataFrame([(t,) for t, _ in good], "t string").select(V.read_spans(F.col("t")).alias("s")).collect()
    assert [[(z.start, z.end) for z in x.s] for x in got] == [s for _, s in good]
    bad = ["[1]", "[1,2,3]", "[4,2]", "[-1,2]", '{"start":1}', '"x"', "nope", "[1,null]", '[[1,2],"x"]']
    df = spark.createDataFrame([(t,) for t in bad], "t string")
    assert all(x[0][-1] is None for x in df.select(V.read_spans(F.col("t"), strict=False)).collect())
    for t in bad:
        with pytest.raises(Exception, match="no span"):
            df.where(df.t == t).select(V.read_spans(F.col("t"))).collect()
    assert df.select(V.read_span(F.lit("[5, 6]"))["end"].alias("e")).first().e == 6


def plain_trim(texts, budget, recent):
    tokens = lambda t: math.ceil(len(t) / 3) if t else 0
    total = lambda xs: 16 + sum(tokens(t) + 12 for t in xs)
    xs, removed, cuts = list(texts), 0, 0
    while total(xs) > budget and len(xs) > 1 + recent:
        n = min(2, len(xs) - recent - 1)
        del xs[1 : 1 + n]
        removed += n
    while xs and total(xs) > budget:
        at = [i for i in range(1, len(xs)) if xs[i]] or [0]
        k = max(at, key=lambda i: tokens(xs[i]))
        most = max(64, 3 * max(32, tokens(xs[k]) // 2))
        if tokens(xs[k]) <= max(32, tokens(xs[k]) // 2) or len(xs[k]) <= most:
            break
        keep = most - len(M.CUT_MARK)
        head = max(16, keep // 2)
        xs[k] = xs[k][:head] + M.CUT_MARK + xs[k][-max(16, keep - head) :]
        cuts += 1
    return xs, removed, cuts


@pytest.mark.parametrize(("budget", "recent"), [(100, 0), (260, 3), (700, 2), (60, 1)])
def test_trimmed_histories(spark, budget, recent):
    r = random.Random(budget)
    talks = [["é" * r.choice([0, 3, 90, 400, 4000]) + "x" for _ in range(r.randint(1, 14))] for _ in range(120)] + [[], [""], ["", ""], ["y" * 5000], ["y" * 5000, ""]]
    df = spark.createDataFrame([(i, [("user", t) for t in x]) for i, x in enumerate(talks)] + [(-1, None), (-2, [("user", None), ("user", "z" * 900)])], "i long, m array<struct<role:string,content:string>>")
    got = {x.i: x.t for x in df.select("i", M.trim_history(F.col("m"), budget, recent).alias("t")).collect()}
    assert got[-1] is None
    for i, x in [*enumerate(talks), (-2, ["", "z" * 900])]:
        assert ([m.content for m in got[i].messages], got[i].removed, got[i].shortened) == plain_trim(x, budget, recent), (i, [len(t) for t in x])


def test_choices(spark):
    runs = [(1, ['WebShop\nInstruction:\nFind "a" lamp, and price lower than 5\n[button] Search [button_]', "Page [SEP] 'two'", "x"], [[f"A {i}" for i in range(50)], ["Only"], ["never"]], [33, 0, -1]), (2, ["unknown goal"], [["a"]], [0]), (3, [], [], []), (4, ["find a lamp"], [["a", "b"]], [1])]
    df = spark.createDataFrame(runs, "run long, states array<string>, available_actions array<array<string>>, action_idxs array<int>")
    goals = spark.createDataFrame([("find a lamp", 7), ("find a lamp", 9), ("other", 1)], "goal string, number long")
    rows, missing = SH.choice_rows(df, goals, 0, 8)
    got = sorted(rows.collect(), key=lambda x: (x.run, x.step))
    assert [(x.run, x.step, x.number, x.n_before) for x in got] == [(1, 0, 7, 50), (1, 1, 7, 1), (4, 0, 7, 2)]
    few = got[0].actions
    assert few[:6] == [f"a {i}" for i in range(6)] and len(few) in (16, 17) and few[got[0].chosen] == "a 33" and few == sorted(few, key=lambda a: int(a[2:])) and got[0].actions == rows.where("run = 1 and step = 0").first().actions
    assert got[1].state == "page [SEP] two" and got[1].actions == ["only"]
    assert sorted(x.run for x in missing.collect()) == [2, 3]
    assert SH.choice_rows(df, goals, 8)[0].count() == 0 and SH.choice_rows(df, goals, 0, None, drop_searches=False)[0].count() == 4


def test_part_log_of_two_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    old, log = PartLog(spark, path, "v1"), PartLog(spark, path, "v2")
    assert log.read() is None and log.read("id long").count() == 0 and log.parts() == {}
    assert old.append(spark.range(100, 110), "id") == 10
    assert log.append(spark.range(5), "id") == 5
    spark.range(1000, 1010).write.parquet(f"{path}/parts/v2/part=00001-lost")  # a job that failed before it was logged
    again = PartLog(spark, path, "v2")  # a restart
    assert again.append(spark.range(8), "id") == 3 and again.append(spark.range(8), "id") == 0
    assert sorted(x.id for x in again.read().collect()) == list(range(8)) and sorted(again.parts()) == [0, 1]
    assert not again.write(spark.range(50, 60), 1)  # another job was first
    assert sorted(x.id for x in log.read().collect()) == list(range(8)) and old.read().count() == 10


NESTED = "k long, x double, m map<string,double>, s struct<a:array<double>,b:string>"


def test_same_rows(spark):
    rows = [(1, math.nan, {"a": 1.0, "b": math.nan}, ([0.0, None], "x")), (1, None, None, None), (2, -0.0, {}, ([], None)), (2, -0.0, {}, ([], None))]
    a = spark.createDataFrame(rows, NESTED)
    b = spark.createDataFrame([(2, 0.0, {}, ([], None)), (1, None, None, None), (1, math.nan, {"b": math.nan, "a": 1.0}, ([-0.0, None], "x")), (2, 0.0, {}, ([], None))], NESTED).repartition(3)
    assert C.same_rows(a, b) and C.differing_keys(a, b, "k").count() == 0
    for other in ([*rows[:3]], [*rows, rows[1]], [rows[0], rows[1], rows[2], (2, -0.0, {}, (None, None))], [rows[0], (1, None, {}, None), *rows[2:]], []):
        assert not C.same_rows(a, spark.createDataFrame(other, NESTED))
    assert not C.same_rows(a, a.withColumnRenamed("x", "y")) and not C.same_rows(a, a.withColumn("k", F.col("k").cast("int")))
    assert C.same_rows(a.limit(0), b.limit(0))


def test_differing_keys(spark):
    a = spark.range(3000).select(F.when(F.col("id") % 1000 != 0, F.col("id") % 700).alias("k"), (F.col("id") % 13).alias("v"))
    b = a.where("k is null or k <> 5").withColumn("v", F.when(F.col("k") == 9, 0).otherwise(F.col("v"))).union(spark.createDataFrame([(None, 1), (9999, 2)], "k long, v long"))
    got = {x.k: (x.a_n, x.b_n) for x in C.differing_keys(a, b, "k").collect()}
    n = {k: a.where(F.col("k").eqNullSafe(F.lit(k))).count() for k in (None, 5, 9)}
    assert got == {None: (n[None], n[None] + 1), 5: (n[5], 0), 9: (n[9], n[9]), 9999: (0, 1)}
    with pytest.raises(ValueError):
        C.differing_keys(a, b.drop("v"), "k")
