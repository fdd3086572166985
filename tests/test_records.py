"""Row builders, checks and small state machines."""

import json

import pytest
from pyspark.sql import functions as F

from trajecta.functions import scoring
from trajecta.operators import prefixes, records


def test_union_columns(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    b = spark.createDataFrame([(1, 2.0, "p"), (2, None, "q")], "k int, x double, y string")
    assert sorted((r["k"], r["y"]) for r in records.union_columns(a, b, "k").collect()) == [(1, "p"), (2, "q")]
    with pytest.raises(Exception, match="differ"):
        records.union_columns(a, b.withColumn("x", F.lit(9.0)), "k").collect()
    with pytest.raises(Exception, match="differ"):
        records.union_columns(a, b.where("k = 1"), "k").collect()


def test_bc_sources_and_splits(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, raw boolean")
    assert df.where(records.bc_should_train("prefix", F.col("raw"))).count() == 1
    with pytest.raises(ValueError):
        records.bc_should_train("none", F.col("raw"))
    a, b = records.split_rows(df, F.col("raw"))
    assert (a.count(), b.count()) == (1, 2)


def test_nested_update_and_flags(spark):
    df = spark.sql("select named_struct('index', 3, 'interaction_kwargs', named_struct('goal', 'a', 'task_id', 1)) e, array('x') acts")
    got = df.select(records.with_kwargs(F.col("e"), goal=F.lit("b")).alias("e"), *[c.alias(k) for k, c in records.episode_flags(F.col("acts"), F.lit("x_Terminal")).items()]).collect()[0]
    assert got["e"]["interaction_kwargs"]["goal"] == "b" and got["e"]["interaction_kwargs"]["task_id"] == 1
    assert (got["is_prefix"], got["is_raw"], got["is_terminal"]) == (True, False, True)


def test_recipes_from_files(spark, tmp_path):
    files = {
        "b.json": {"type": "minecraft:crafting_shaped", "pattern": ["##", "# "], "key": {"#": {"tag": "planks"}}, "result": {"item": "box", "count": 2}},
        "a.json": {"type": "minecraft:crafting_shapeless", "ingredients": [{"item": "log"}, [{"item": "coal"}, {"item": "x"}]], "result": "torch"},
        "c.json": {"type": "smelting", "result": "glass"},
    }
    for k, v in files.items():
        (tmp_path / k).write_text(json.dumps(v))
    out, inp = records.read_recipes(spark, str(tmp_path / "*.json"))
    assert sorted((r["output"], r["count"]) for r in out.collect()) == [("box", 2), ("torch", 1)]
    assert sorted((r["name"], r["is_tag"], r["count"]) for r in inp.collect()) == [("coal", False, 1), ("log", False, 1), ("planks", True, 3)]


def test_recipe_set_is_bounded(spark):
    closure = spark.createDataFrame([("g", "log", None), ("g", "g", 0)], "goal string, item string, recipe int")
    uses = spark.createDataFrame([("log", i) for i in range(30)], "item string, recipe int")
    got = records.recipe_set(closure, uses, 8, 5).collect()
    assert sum(r["distractor"] for r in got) == 5 and sum(not r["distractor"] for r in got) == 1


def test_cache_and_resume(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert records.cached(spark, str(tmp_path / "n3"), make).count() == 3
    assert made == [1]
    v = spark.range(3).withColumn("v", F.lit(1))
    assert records.cache_valid(v, v, "id", "v") and not records.cache_valid(v, v.where("id < 2"), "id", "v")
    done = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), (None, 1, 3)], "task string, s int, line int")
    todo = spark.createDataFrame([("t", 0), ("t", 1)], "task string, s int")
    assert [(r["task"], r["s"]) for r in records.resume_eval(done, todo, "task", "s", "line").collect()] == [("t", 1)]


def test_bucket_and_controller():
    now = [0.0]
    b = records.TokenBucket(2.0, 4.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert b.take(4) == 0.0 and b.take(1) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        b.take(5)
    assert records.controller([2.0, 0.0], 1.0, 1.0, 1.0) == pytest.approx([1.2, 0.96])


def test_maths():
    assert scoring.last_boxed("a \\boxed{\\frac{1}{2}} b") == "\\frac{1}{2}" and scoring.last_boxed("none") is None
    for a, b, want in [("\\dfrac{1}{2}", "0.5", True), ("1/2", "\\frac12", True), ("\\frac{2}{4}", "\\frac{1}{2}", False), ("(1, 2)", "(1,2)", True), ("(1,2)", "(2,1)", False), ("5\\text{ cm}", "5", True), ("\\frac{4}{2}", "2", False), ("x+1", "x+2", False), (None, "1", False)]:
        assert scoring.same_math(a, b) is want, (a, b)


def test_sequence_advantage_modes(spark):
    for mode in (*prefixes.MODES, *prefixes.ALIASES):
        assert spark.range(1).select(prefixes.sequence_advantage(F.lit(-0.5), mode, 1.0, F.lit(1.0), F.lit(0.2)).alias("x")).collect()[0]["x"] is not None
    with pytest.raises(ValueError):
        prefixes.sequence_advantage(F.lit(1.0), "nothing")
    with pytest.raises(ValueError):
        prefixes.sequence_advantage(F.lit(1.0), "family_lift")
