"""Hand-worked examples and invariants of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trajecta.functions import arrays as A
from trajecta.functions import text as X
from trajecta.operators import advantage, batch, catalog, cuts, graph, losses, messages, metrics, stateful


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


@pytest.fixture(scope="module")
def groups(spark):
    rows = [("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 0.5), ("b", 1, 2.0), ("c", 1, 1.0), ("c", 2, 1.0)]
    return spark.createDataFrame(rows, "uid string, rid int, score double")


def get(df, col="advantage"):
    return {(r["uid"], r["rid"]): r[col] for r in df.collect()}


def test_grpo_singleton_equal_and_spread(groups):
    got = get(advantage.get("grpo")(groups, group="uid", score="score"))
    assert got["a", 1] == pytest.approx(0.5 / (0.5 + 1e-6))
    assert got["b", 1] == pytest.approx(2.0 / (1 + 1e-6))
    assert got["c", 1] == 0.0


def test_rloo_kinds_differ_on_singletons(groups):
    assert get(advantage.get("rloo")(groups, group="uid", score="score"))["b", 1] == 2.0
    got = get(advantage.get("rloo_vectorized")(groups, group="uid", score="score"))
    assert got["b", 1] == 0.0 and got["a", 1] == pytest.approx(0.75)


def test_passk_needs_two(groups):
    with pytest.raises(Exception, match="group of one"):
        advantage.get("grpo_passk")(groups, group="uid", score="score", order="rid").collect()
    got = get(advantage.get("grpo_passk")(groups.where("uid <> 'b'"), group="uid", score="score", order="rid", by_std=False))
    assert got["a", 1] == 0.5 and got["a", 2] == 0.0 and got["c", 1] == 0.0


def test_registry_names():
    assert set(advantage.ESTIMATORS) == {"gae", "grpo", "reinforce_plus_plus", "reinforce_plus_plus_baseline", "remax", "rloo", "opo", "grpo_passk", "gpg", "rloo_vectorized", "grpo_vectorized"}
    with pytest.raises(ValueError):
        advantage.get("nothing")
    assert {"vanilla", "gspo", "gpg", "clip_cov", "kl_cov", "geo_mean", "drpo"} <= set(losses.LOSSES)


def test_gae_against_recurrence(spark):
    r, v, m = [1.0, 0.0, 2.0, 1.0], [0.5, 0.2, 0.1, 0.3], [1.0, 1.0, 0.0, 1.0]
    nxt = last = 0.0
    want = []
    for a, b, k in zip(r[::-1], v[::-1], m[::-1], strict=True):
        if k:
            last, nxt = a + 0.9 * nxt - b + 0.9 * 0.8 * last, b
        want.append(last)
    lit = lambda x: F.array(*map(F.lit, x))
    assert one(spark, A.gae(lit(r), lit(v), lit(m), 0.9, 0.8)) == pytest.approx(want[::-1])


def test_arrays(spark):
    ids = F.array(*map(F.lit, [20, 10, 34, 1, 0, 0, 0]))
    assert one(spark, A.response_mask(ids, 1)) == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, A.span_mask(F.lit(0), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"))))) == []
    assert one(spark, A.pass_at_k(F.lit(4), F.lit(2), 2)) == pytest.approx(1 - 1 / 6)
    assert one(spark, A.pass_at_k(F.lit(1), F.lit(1), 2)) is None
    with pytest.raises(ValueError):
        A.kl(F.lit(1.0), F.lit(1.0), "full")


def test_text(spark):
    assert one(spark, X.action_strict(F.lit("Thought: x\nAction: get 1 log!"))) == "get 1 log"
    assert one(spark, X.action_strict(F.lit("Action: a\nAction: b"))) is None
    assert one(spark, X.code10(F.lit(""))) == "DA39A3EE5E" and one(spark, X.code10(F.lit("ABC"))) == "3C01BDBB26"
    assert one(spark, X.normalize_color(F.lit("violet lavender"), ["lavender"])) == "lavender"
    assert one(spark, X.normalize_color(F.lit("webshop"), ["lavender"])) == "webshop"
    assert one(spark, X.normalize_size(F.lit("142"), ["(.*)plus"])) == "numeric_size"
    assert one(spark, X.prices(F.lit("nothing"))) == [100.0]
    assert one(spark, X.null_safe_double(F.lit("NaN"))) is None
    assert one(spark, X.collapse(F.lit(" a  b\n"))) == "a b"


def test_rewards(spark):
    assert one(spark, catalog.category_match(F.lit("a › b"), F.lit("b › a"))) is True
    assert one(spark, catalog.category_match(F.lit("a › b"), F.lit("a › d"))) is False
    lit = lambda x: F.array(*map(F.lit, x))
    assert one(spark, catalog.attribute_hits(lit(["tea tree", "essential oils", "natural ingredients"]), lit(["tea tree", "essential oil"]), F.lit(""))) == 2
    assert one(spark, catalog.option_hits(lit(["powder snow"]), lit(["cool powder snow"]), [])) == 1
    assert one(spark, catalog.total_reward(F.lit(1), F.lit(0), F.lit(True), F.lit(2), F.lit(0), F.lit(1.0))) == pytest.approx(2 / 3)
    assert one(spark, catalog.option_combinations(F.create_map().cast("map<string,array<string>>"))) == [[]]


def test_messages(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "u0"), ("assistant", "Action: a"), ("user", "u1"), ("assistant", "Action: b"), ("user", "u2")])] + [(2, 0, "user", "alone")]
    df = messages.gather(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    a, b = messages.split_at(F.col("messages"), F.lit(0))
    got = {r["conv_id"]: (len(r["a"]), len(r["b"])) for r in df.select("conv_id", a.alias("a"), b.alias("b")).collect()}
    assert got == {1: (2, 3), 2: (0, 1)}
    last = messages.split_at(F.col("messages"), F.lit(9))
    assert len(df.where("conv_id = 1").select(last[0].alias("a")).collect()[0]["a"]) == 4
    assert [one(spark, messages.cut_turn(F.lit(n), 0.3)) for n in (0, 1, 2, 5)] == [0, 0, 1, 2]


def test_metrics(spark):
    df = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("max_reward", 5.0), ("max_reward", 8.0), ("min_error", 0.1), ("min_error", 0.05)], "key string, value double")
    assert {r["key"]: r["value"] for r in metrics.by_name(df).collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}
    votes = spark.createDataFrame([("g", "A", 0.9, 0), ("g", "B", 0.8, 1), ("g", "A", 0.7, 2)], "uid string, vote string, v double, i int")
    assert metrics.majority(votes, "uid", "vote", "v", "i").collect()[0]["value"] == 0.9
    with pytest.raises(Exception, match="fewer than two"):
        metrics.masked(spark.createDataFrame([(1.0, 1)], "v double, m int"), "v", "m").collect()


def test_partitions():
    r = random.Random(1)
    for _ in range(50):
        n, k = r.randint(1, 30), r.randint(1, 5)
        c = [r.randint(1, 100) for _ in range(n)]
        p = batch.largest_differencing(c, k, False)
        sums = [sum(x for x, q in zip(c, p, strict=True) if q == i) for i in range(k)]
        assert len(p) == n and max(sums) - min(sums) <= max(c)
    p = batch.largest_differencing([5, 4, 3, 2], 2, True)
    assert sorted(p.count(i) for i in range(2)) == [2, 2]
    with pytest.raises(ValueError):
        batch.largest_differencing([1, 2, 3], 2, True)
    assert batch.greedy([3, 1, 1], 2) == [0, 1, 1]


def test_ordinals_pads_and_empty(spark):
    df = spark.range(0, 23).withColumnRenamed("id", "k")
    got = sorted((r["ordinal"], r["k"]) for r in batch.with_ordinal(df, ["k"]).collect())
    assert got == [(i, i) for i in range(23)]
    x = batch.pad_to(batch.with_ordinal(spark.range(3).withColumnRenamed("id", "k"), ["k"]), "ordinal", 8)
    assert sorted(r["ordinal"] for r in x.collect()) == list(range(8))
    assert batch.repeat(df, 0).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "s string, d string")
    got = graph.closure(e, "s", "d", spark.createDataFrame([("a",)], "node string"), "node").collect()
    assert {(r["node"], r["hops"]) for r in got} == {("a", 0), ("b", 1), ("c", 2)}
    rec = spark.createDataFrame([(1, "plank"), (2, "stick"), (3, "loop"), (4, "stick")], "recipe int, output string")
    inp = spark.createDataFrame([(1, "log"), (2, "plank"), (3, "loop"), (4, "log"), (4, "plank")], "recipe int, item string")
    assert {r["item"]: r["depth"] for r in graph.min_depth(rec, inp).collect()} == {"log": 0, "plank": 1, "stick": 2}


def test_craft_steps():
    recipes = {"planks": [(4, {"log": 1})]}
    bag, obs, reward, done = stateful.craft_step({}, "get 1 log", recipes, "planks")
    assert (bag, obs, done) == ({"log": 1}, "Got 1 log", False)
    bag, obs, reward, done = stateful.craft_step(bag, "craft 4 planks using 1 log", recipes, "planks")
    assert bag["planks"] == 4 and reward == 1.0 and done
    assert stateful.craft_step(bag, "get 1 planks", recipes, None)[1].startswith("Could not find")
    assert stateful.craft_step({}, "craft 4 planks using 1 log", recipes, None)[1].startswith("Could not find enough")
    assert stateful.craft_step({}, "dance", recipes, None)[1] == "Could not execute dance"


def test_change_topk_ties_by_place(spark):
    df = spark.createDataFrame([(1, i, 1.0, i // 3) for i in range(9)], "uid int, i int, v double, turn int")
    got = [(r["turn"], r["pos"]) for r in cuts.change_topk(df, "uid", ["i"], "v", "turn", 3, 2).orderBy("candidate_rank").collect()]
    assert got == [(0, 1), (1, 4)]


def test_ppo_values(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 1.0), (1, 3.0, 0.0, -1.0)], "seq int, lp double, op double, adv double")
    got = sorted(r["loss"] for r in losses.LOSSES["vanilla"](df, "lp", "op", "adv").collect())
    assert got == pytest.approx(sorted([-1.0, -1.2, min(math.exp(3.0), 3.0)]))
