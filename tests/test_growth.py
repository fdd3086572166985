"""Work that grew faster than its input, or stayed on one core."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import graph, layout, rewards, shop
from trajecta.plans import catalogue
from trajecta.plans.base import parts_by_rows


def test_resamples_are_those_of_the_hash_with_nulls_and_ties(spark):
    values = {1: [3.0, None, 4.0, float("nan"), 2.0], 2: [1.0, 5.0], 3: [7.0]}
    votes = {1: ["a", "b", None, "b", "a"], 2: ["x", "y"], 3: ["z"]}
    df = spark.createDataFrame([("s", u, i, v, votes[u][i]) for u, vs in values.items() for i, v in enumerate(vs)], "s string, u long, i int, v double, p string")
    got = {x.metric: x.value for x in rewards.validation_table(df, "s", "u", "v", "i", vote="p", draws=60, seed=9).collect()}
    hashes = {(x.u, x.d, x.i): x.h for x in spark.range(1, 3).selectExpr("id u", "explode(sequence(0, 59)) d").selectExpr("*", "explode(sequence(1, 5)) i").select("u", "d", "i", F.xxhash64(F.lit(9), "u", "d", "i").alias("h")).collect()}

    def mean(k, f):
        per = []
        for u in (1, 2):
            n = len(values[u])
            if k == n or k == 2:
                x = [f([hashes[u, d, i + 1] % n for i in range(k)], values[u], votes[u]) for d in range(60)]
                x = [v for v in x if v is not None]
                per.append(sum(x) / len(x))
        return sum(per) / len(per)

    def maj(at, vs, ps):
        vote = max([ps[i] for i in at], key=lambda p: sum(ps[i] == p for i in at))  # the first of the most frequent
        return None if vote is None else vs[next(i for i in at if ps[i] == vote)]

    worst = lambda at, vs, ps: min((vs[i] for i in at if vs[i] is not None), key=lambda v: (v != v, v), default=None)
    assert got["worst@2/mean"] == pytest.approx(mean(2, worst), nan_ok=True) and got["worst@5/mean"] == pytest.approx(mean(5, worst), nan_ok=True)
    assert got["maj@2/mean"] == pytest.approx(mean(2, maj), nan_ok=True) and got["maj@5/mean"] == pytest.approx(mean(5, maj), nan_ok=True)


def test_resampling_takes_no_square_of_the_responses(spark):
    """2,000 different votes: every one against every other would take minutes."""
    df = spark.range(2000).selectExpr("'s' s", "1L u", "id i", "cast(id as double) v", "cast(id as string) p")
    start = time.time()
    got = {x.metric: x.value for x in rewards.validation_table(df, "s", "u", "v", "i", vote="p", draws=1000).collect()}
    assert time.time() - start < 60 and got["best@2000/mean"] > 1995 and got["worst@2000/mean"] < 4
    x = np.array([[0, 1], [1, 0], [1, 2]])
    assert rewards.majority(x, np.array([5, 6, 7])).tolist() == [1, 1]


def test_listed_searches_rank_lists_and_not_pairs(spark):
    lists = spark.createDataFrame([(i, v) for i in range(11) for v in ("<a> x", "<c> y") if i % 3 or v == "<a> x"], "product long, _v string")
    searches = spark.createDataFrame([(s, v) for s, v in enumerate(["<a> x", "<a> x", "<c> y", "<q> none", None])], "search long, _v string")
    found = shop.listed_products(searches, lists, block=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(search" not in plan
    c = [i for i in range(11) if i % 3]
    want = [(s, p, r + 1) for s in (0, 1) for r, p in enumerate(range(11))] + [(2, p, r + 1) for r, p in enumerate(c)]
    assert sorted(map(tuple, found.collect())) == want


def test_listed_products_come_with_runs_of_searches_in_many_tasks(spark):
    lists = spark.createDataFrame([(p, "<a> x") for p in range(300)] + [(p, "<c> y") for p in range(0, 300, 7)] + [(None, "<c> y")], "product long, _v string").repartition(3)
    searches = [(s, "<a> x") for s in range(300)] + [(5, "<c> y"), (5, "<c> y"), (None, "<c> y"), (7, "<q> none"), (8, None)]
    asked = spark.createDataFrame(searches, "search long, _v string").repartition(3)
    own = {"<a> x": list(range(300)), "<c> y": [None, *range(0, 300, 7)]}
    want = sorted(((s, p, r + 1) for s, v in searches if v in own for r, p in enumerate(own[v])), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for long lists
    try:
        tasks = shop.listed_products(asked, lists).rdd.glom().collect()
        assert sorted((tuple(r) for t in tasks for r in t), key=repr) == want
        # a product stands once for the run of 300 searches, not once for each search
        assert sum(1 for t in tasks for a, b in zip(t, t[1:]) if a["product"] != b["product"]) <= 300 + len(own["<c> y"])
        small = shop.listed_products(asked, lists, block=32, run=16, pairs=5000)
        assert sorted(map(tuple, small.collect()), key=repr) == want and small.rdd.getNumPartitions() >= len(want) / 5000
        assert max(len(t) for t in small.rdd.glom().collect()) < len(want) / 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_one_small_file_are_worked_off_on_all_cores(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    for name in ("fuzzy_attribute_match", "total_reward", "maths_grades", "product_pages"):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        n = re.search(r"RepartitionByExpression \[p_partkey#\d+L?\], (\d+)", plan)
        assert n and int(n[1]) >= cores, name


def test_recipes_meet_by_names_and_not_pairwise(spark):
    """6,000 inputs of one tag against 6,000 offered items that have it: 36 million pairs, which no join may make."""
    n = 6000
    inputs = spark.range(n).selectExpr("1L recipe", "concat('t', id) item", "true is_tag", "id % 7 count")
    offers = spark.range(n).selectExpr("'ok' offer", "1L recipe", "concat('i', id) item", "id % 7 count").unionByName(spark.range(n - 1).selectExpr("'less' offer", "1L recipe", "concat('i', id) item", "id % 7 count"))
    tags = spark.range(n).selectExpr("concat('i', id) item", "concat('t', id) tag")
    found = graph.matches(offers, inputs, tags, 3)
    assert {x.offer: x.valid for x in found.collect()} == {"ok": True, "less": False}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, .*recipe", plan)
    plain = graph.matches(offers, inputs.drop("is_tag"), parts=3)
    assert {x.offer: x.valid for x in plain.collect()} == {"ok": False, "less": False}


def test_recipes_are_dealt_by_rows_and_joined_with_none(spark):
    inputs = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "recipe int, item string, count int")
    offers = spark.createDataFrame([("x", 1, "a", 1), ("x", 1, "a", 1), ("x", 1, "b", 1), ("y", 1, "a", 2), ("x", 2, "a", 1), ("x", 2, None, 1), ("y", 2, "b", 1), ("z", 3, "a", 1)], "offer string, recipe int, item string, count int")
    found = graph.matches(offers, inputs, parts=5)
    assert {(x.offer, x.recipe): x.valid for x in found.collect()} == {("x", 1): True, ("y", 1): False, ("x", 2): False, ("y", 2): False, ("z", 3): False}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and re.search(r"RepartitionByExpression \[recipe#\d+L?\], 5", plan)
    assert parts_by_rows(spark.range(1000), 10) == 100 and parts_by_rows(spark.range(1), 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_depths_are_written_once(spark, monkeypatch):
    rows = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append(cut(df)) or rows[-1])
    edges = [(f"{d}.{i}", f"{d - 1}.{(i * 7 + j) % 12}") for d in range(1, 6) for i in range(12) for j in (0, 3)] + [("loop", "5.1"), ("loop", "loop"), ("5.1", None)]
    e = spark.createDataFrame(edges, "recipe string, item string")
    got = {x.item: x.depth for x in graph.min_depth(e.selectExpr("recipe", "recipe output").distinct(), e).collect()}
    assert got == {f"{d}.{i}": d for d in range(6) for i in range(12)} | {None: 0}
    assert sum(spark.read.schema(x.schema).parquet(x._trajecta_path).count() for x in rows if "depth" in x.columns) == len(got)


def test_one_rank_is_worked_off_by_several_tasks(spark):
    def work(parts):
        for pdf in parts:
            at = pdf["ordinal"].tolist()
            yield pdf.assign(n=len(pdf), ok=at == sorted(at))[["rank", "ordinal", "n", "ok"]]

    df = spark.range(1000).withColumnRenamed("id", "ordinal")
    got = layout.dispatch(df, "rank_zero", "ordinal", 5, work, "rank int, ordinal long, n int, ok boolean", 8).collect()
    assert sorted(x.ordinal for x in got) == list(range(1000)) and all(x.rank == 0 and x.ok for x in got) and max(x.n for x in got) < 500
