"""Operators without SQL, and hand-worked cases of the others."""

import random

import pytest
from pyspark.sql import functions as F

from trajecta.functions import actions as A
from trajecta.functions import arrays, text
from trajecta.operators import catalog, cuts, graph, layout, losses, metrics, prefixes, rewards, shop, stateful
from trajecta.operators import training_rows as R
from trajecta.streaming.loader import BatchLoader, HashSampler, run_epochs


def values(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_letter_ratio_is_that_of_the_longest_common_subsequence(spark):
    r = random.Random(1)
    pairs = [("blue", "blur"), ("", ""), ("", "a"), ("é漢x", "漢x")] + [("".join(r.choice("abc ") for _ in range(r.randint(0, 150))), "".join(r.choice("abc ") for _ in range(r.randint(0, 150)))) for _ in range(60)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", catalog.common_letters(F.col("a"), F.col("b")).alias("n"), catalog.letter_ratio(F.col("a"), F.col("b")).alias("q")).collect()
    for x in got:
        a, b = pairs[x.i]
        assert x.n == lcs(a, b) and x.q == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)) if a + b else 100)
    one = lambda a, b: values(spark, catalog.token_set_ratio(F.lit(a), F.lit(b)))[0]
    assert one("blue", "blur") == 75 and one("blue sky", "sky blue now") == 100 and one("essential oil", "essential oils") > 85 and one("", "a") == 0


def test_parsers(spark):
    lit = F.lit
    got = values(spark, A.science(lit("plain last line")), A.science(lit("<think>[[ Look  Around ]]</think>")), A.household(lit("[[ ]] [[Take Mug]]")), A.household(lit("go\n\n")), A.grid(lit("I will toggle\nnothing here")), A.grid(lit("hm")), A.qa_search(lit("[[ SEARCH[ a b ] ]]")), A.store(lit("search[x]\nAction: click[y] search[z]")), A.store(lit("click[a] search[b] search[c]")), A.store(lit("Click[a]")))
    assert got == [None, "look around", "take mug", "go", "i will toggle", None, "search[a b]", "search[z]", "search[c]", None]
    assert values(spark, A.science(lit("[[ a > b ]]\nAction: [[ wait ]]")), A.science(lit("x" * 10)), A.action_for(lit("none"), lit("x"))) == ["wait", None, None]
    acts = F.array(lit("go"), lit(" "), lit("look "))
    assert values(spark, A.with_actions(lit("You see.\n"), acts), A.with_actions(lit("x"), F.lit(None).cast("array<string>"))) == ["You see.\nAVAILABLE ACTIONS: go,look", "x"]


def test_own_parser_takes_a_name(spark):
    @A.parser("own")
    def own(c):
        return F.upper(c)

    try:
        assert values(spark, A.action_for(F.lit("own"), F.lit("x"))) == ["X"]
    finally:
        del A.PARSERS["own"]


def test_pages(spark):
    page = text.render_page(F.lit("t"), F.array(F.lit("a < b"), F.lit("c")), F.array(F.lit("Buy & go")))
    assert values(spark, text.page_observation(page)) == ["a < b [SEP] c [SEP] [button] Buy & go [button_]"]


def test_dealt_positions():
    r = random.Random(2)
    for _ in range(100):
        ranks, mini = r.choice([1, 2, 4]), r.choice([None, 8])
        costs = [r.randint(1, 50) for _ in range(8 * r.randint(1, 4))]
        place = layout.dealt_positions(costs, ranks, mini)
        assert sorted(place) == list(range(len(costs)))
        each = len(costs) // ranks
        for k in range(ranks):
            own = sorted((p, c) for p, c in zip(place, costs, strict=True) if p // each == k)
            half = [c for _, c in own]
            assert half[: (each + 1) // 2] == sorted(half[: (each + 1) // 2]) and half[(each + 1) // 2 :] == sorted(half[(each + 1) // 2 :], reverse=True)
            if mini:
                back = [i for i, p in enumerate(place) if p // each == k]
                assert all(sum(a <= i < a + 8 for i in back) == 8 // ranks for a in range(0, len(costs), 8))
    with pytest.raises(ValueError):
        layout.dealt_positions([1, 2, 3], 1, 2)


def test_layouts_raise(spark):
    with pytest.raises(Exception, match="permutation"):
        layout.inverse(spark.createDataFrame([(0, 1), (1, 1)], "i int, j int"), "i", "j").collect()
    with pytest.raises(ValueError):
        layout.dispatch(spark.range(4), "no such", "id", 2, None, "id long")
    with pytest.raises(Exception, match="divide"):
        layout.MODES["dp_compute"](spark.range(5), "id", 2).collect()
    p = layout.padded(spark.createDataFrame([([1, 2],), (None,)], "v array<int>"), "v", F.lit(0), left=True, multiple=3).collect()
    assert [(list(x.v), list(x.mask)) for x in p] == [([0, 1, 2], [0, 1, 1]), ([0, 0, 0], [0, 0, 0])]


def test_episodes():
    caps = {"assistant_turns": 2, "user_turns": 9, "tokens": 100, "interaction": True}
    s = {"state": "pending", "assistant_turns": 0, "user_turns": 0, "tokens": 0}
    seen = []
    for event, calls, tokens, stop in [("generated", 0, 5, False), ("start", 0, 0, False), ("generated", 1, 10, False), ("reply", 0, 1, False), ("tools", 0, 5, False), ("generated", 0, 10, False), ("reply", 0, 1, True)]:
        s = stateful.episode_step(s, event, calls, tokens, stop, caps)
        seen.append((s["state"], s["tokens"]))
    assert seen == [("pending", 0), ("generating", 0), ("tools", 10), ("tools", 10), ("generating", 15), ("terminated", 25), ("terminated", 25)]
    alone = stateful.episode_step({**s, "state": "generating", "assistant_turns": 0}, "generated", 0, 1, False, {"assistant_turns": 9, "user_turns": 9, "tokens": 99})
    assert alone["state"] == "terminated"


def test_shop_session():
    s = shop.start_session("apple")
    items = {"apple": {"color": ["Red"]}}
    pages = []
    for a in ["click[apple]", "search[fruit]", "click[next >]", "click[apple]", "click[red]", "click[reviews]", "click[< prev]", "click[buy now]", "search[x]"]:
        s = shop.shop_step(s, a, items)
        pages.append(s["page"])
    assert pages == ["index", "results", "results", "item", "item", "sub", "item", "done", "done"]
    assert s["reward"] == 1.0 and s["options"] == {"color": "red"} and s["actions"] == {"invalid": 1, "search": 1, "click": 6} and s["number"] == 2


def test_goals(spark):
    g = spark.createDataFrame([(i, float(i % 3)) for i in range(300)], "k int, w double")
    got = {x.k for x in shop.select_goals(g, "k", "w", 120).collect()}
    assert len(got) == 120 and not any(k % 3 == 0 for k in got) and sum(k % 3 == 2 for k in got) > 66
    assert shop.select_goals(g, "k", "w", -1, F.col("k") < 5).count() == 5


def test_rewards(spark, tmp_path):
    f = tmp_path / "r.py"
    f.write_text("def near(source, response, truth, extra, off=0.5):\n    if response == 'bad':\n        raise ValueError\n    return {'score': 1.0 if response == truth else off, 'source': source}\n")
    assert rewards.load_reward(None, None) is None
    with pytest.raises(FileNotFoundError):
        rewards.load_reward(str(tmp_path / "none.py"), "x")
    with pytest.raises(AttributeError):
        rewards.load_reward(str(f), "far")
    (tmp_path / "b.py").write_text("1 / 0")
    with pytest.raises(RuntimeError):
        rewards.load_reward(str(tmp_path / "b.py"), "x")
    df = spark.createDataFrame([("s", "a", "a"), ("s", "b", "a"), ("s", "bad", "a")], "source string, response string, truth string")
    got = rewards.manage(df, rewards.load_reward(str(f), "near", off=0.25), "source", "response", "truth", failed=-1.0).collect()
    assert [(x.score, x.score_info) for x in got] == [(1.0, '{"source": "s"}'), (0.25, '{"source": "s"}'), (-1.0, "{}")]
    with pytest.raises(Exception):
        rewards.manage(df, rewards.load_reward(str(f), "near"), "source", "response", "truth").collect()


def test_validation_by_hand(spark):
    rows = [("s", "u", i, v, p) for i, (v, p) in enumerate([(1.0, "A"), (3.0, "B"), (1.0, "A")])] + [("s", "w", 9, 5.0, "C")]
    df = spark.createDataFrame(rows, "s string, u string, i int, v double, p string")
    got = {x.metric: (x.value, x.n_uid) for x in rewards.validation_table(df, "s", "u", "v", "i", vote="p", draws=300).collect()}
    assert got["mean@3"] == (pytest.approx(5 / 3), 1) and got["std@3"][0] == pytest.approx((8 / 9) ** 0.5) and got["mean@1"] == (5.0, 1)
    assert 1.0 <= got["worst@3/mean"][0] < got["maj@3/mean"][0] < got["best@3/mean"][0] <= 3.0 and got["best@2/std"][0] > 0
    lit = lambda x: F.array(*map(F.lit, x))
    assert values(spark, rewards.majority_value(lit("ABCBA"), lit([1, 2, 3, 4, 5])), rewards.majority_value(lit("AB"), lit([7, 8]))) == [1, 7]


def test_loader_goes_on(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    path = f"file://{tmp_path}/loader"
    first = BatchLoader(df, path, 4, HashSampler("k"))
    a = {x.k for x in first.batch().collect()}
    first.done()
    again = BatchLoader(df, path, 4, HashSampler("k"))
    b = {x.k for x in again.batch().collect()}
    assert len(a) == len(b) == 4 and not a & b
    again.done()
    assert again.batch() is None  # two rows are left, and the last batch is dropped
    seen = []
    assert run_epochs(again, 2, lambda e, x: seen.append((e, x.count()))) == 2 and seen == [(1, 4), (1, 4)]
    assert BatchLoader(df, path, 4, HashSampler("k")).epoch == 2


def test_slots_and_retries():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x * 2

    assert stateful.with_retries(flaky, 3, 0)(4) == 8 and calls == [4, 4, 4]
    with pytest.raises(OSError):
        stateful.with_retries(lambda: (_ for _ in ()).throw(OSError()), 2, 0)()
    with stateful.Slots(1) as s:
        assert not s.free.acquire(blocking=False)
    assert s.free.acquire(blocking=False)


def test_sequence_advantages_by_name(spark):
    m, lift = F.lit(-0.4), F.lit(2.0)
    assert values(spark, prefixes.sequence_advantage(m, " Cont-Mean-ABS "), prefixes.sequence_advantage(m, "family-lift-positive", lift=-lift), prefixes.sequence_advantage(m, "family_lift", lift=-lift, clip=0.5), prefixes.sequence_advantage(m, "cont_abs_family_lift", lift=lift, clip=0)) == [0.4, 0.0, -0.5, 2.4]
    with pytest.raises(ValueError):
        prefixes.sequence_advantage(m, "family_lift")
    with pytest.raises(ValueError):
        prefixes.sequence_advantage(m, "nothing")


def test_losses_leave_masked_tokens_out(spark):
    rows = [(1, 0, -0.1, -0.1, 1.0, 1), (1, 1, -9.0, -0.1, 1.0, 0), (2, 0, None, None, 1.0, None)]
    df = spark.createDataFrame(rows, "seq int, pos int, lp double, op double, adv double, mask int")
    got = {x.seq: x.loss for x in losses.LOSSES["geo_mean"](df, "lp", "op", "adv", mask="mask").collect()}
    assert got == {1: pytest.approx(-1.0), 2: 0.0}
    picked = losses.LOSSES["kl_cov"](df, "lp", "op", "adv", mask="mask").where("picked = 1").collect()
    assert [(x.seq, x.pos) for x in picked] == [(1, 0)]
    kept = {(x.seq, x.pos): (x.weight, x.keep) for x in losses.corrected(df, "lp", "op", "seq", "mask").collect()}
    assert kept == {(1, 0): (1.0, 1), (1, 1): (0.0, 0), (2, 0): (0.0, 0)}
    with pytest.raises(ValueError):
        losses.LOSSES["vanilla"](df, "lp", "op", "adv", dual=1.0)


def test_replay_order_and_subset(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b", "c"]), ("g", 2, ["a"]), ("g", 3, ["a", "x"]), ("g", 4, None), ("g", 5, [])], "g string, k int, acts array<string>")
    got = {x.k: (x.turn, x.shared) for x in R.replay_order(df.where("acts is not null"), "g", "acts", "k").collect()}
    assert got == {5: (0, 0), 2: (1, 0), 3: (2, 1), 1: (3, 1)}
    assert [x.k for x in R.debug_subset(df, F.size("acts") > 0, ["k"], 4).collect()] == [1, 2, 3, 4]


def test_recipe_tags_and_texts(spark):
    inputs = spark.createDataFrame([(1, "planks", True, 2), (1, "coal", False, 1)], "recipe int, item string, is_tag boolean, count int")
    tags = spark.createDataFrame([("oak", "planks"), ("birch", "planks")], "item string, tag string")
    offers = spark.createDataFrame([("ok", 1, "oak", 2), ("ok", 1, "coal", 1), ("tag", 1, "planks", 2), ("tag", 1, "coal", 1), ("mixed", 1, "oak", 1), ("mixed", 1, "birch", 1), ("mixed", 1, "coal", 1), ("extra", 1, "oak", 2), ("extra", 1, "coal", 1), ("extra", 1, "log", 1), ("none", 7, "oak", 1)], "offer string, recipe int, item string, count int")
    got = {x.offer: x.valid for x in graph.matches(offers, inputs, tags).collect()}
    assert got == {"ok": True, "tag": True, "mixed": False, "extra": False, "none": False}
    assert values(spark, graph.parse_recipe(F.lit("craft 4 a b using 2 log, 1 x"))["parts"], graph.parse_recipe(F.lit("no")))[0] == ["2 log", "1 x"]


def test_small_metrics(spark):
    lit = lambda x: F.array(*map(F.lit, x))
    assert values(spark, arrays.diff_count(lit([1, 2, 3]), lit([1, 9, 9]), lit([1, 1, 0])), arrays.diff_count(F.array().cast("array<int>"), lit([1]), lit([1])), arrays.diff_count(lit([1]), lit([1, 2]), lit([1]))) == [1, 0, None]
    assert values(spark, metrics.category_rank(F.lit("b"), ["a", "b"]), metrics.category_rank(F.lit(None).cast("string"), ["a"]), metrics.level_rank(F.lit("level_12")), metrics.level_rank(F.lit(None).cast("string"))) == [1, 1, 12, 10**9]
    with pytest.raises(Exception, match="unique"):
        metrics.unique_key(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()
    p = spark.createDataFrame([("a", 5), ("a", 50), ("a", 0), ("b", 1)], "d string, p int")
    s = spark.createDataFrame([("a", 2, 8, 1), ("a", 10, 20, 2), ("a", 4, 9, 3)], "d string, s int, e int, n int")
    got = sorted((x.d, x.p, x.span, x.policy, x.distance) for x in cuts.nearest_span(p, s, "d", "p", "s", "e", "n").collect())
    assert got == [("a", 0, 1, "first", 2), ("a", 5, 1, "contained", 0), ("a", 50, 2, "previous", 31), ("b", 1, None, None, None)]
    near = {x.p: (x.span, x.distance) for x in cuts.nearest_span(spark.createDataFrame([("a", 9), ("a", 0)], "d string, p int"), s.where("n <> 3"), "d", "p", "s", "e", "n", "nearest").collect()}
    assert near == {9: (2, 1), 0: (1, 2)}
