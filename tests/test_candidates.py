"""Candidate prefixes, demonstrations and whole runs against plain versions."""

import pytest
from pyspark.sql import functions as F

from trajecta.functions import text as X
from trajecta.operators import candidates as CA
from trajecta.sources import tables as T

MESSAGES = "array<struct<role:string,content:string>>"
GOOD, TWO, EMPTY, NONE = "Thought: t\nAction: get 1 log", "Action: a\nAction: b", "Action: !!", "hello"


def talk(*said):
    return [("user", "u")] + [("assistant", t) for t in said]


def test_runtime_split(spark):
    rows = [(1, talk(GOOD), ["x"], False), (2, talk(GOOD, TWO, NONE, EMPTY), ["x"], False), (3, talk(GOOD), [], False), (4, talk(TWO), [], True), (5, None, None, None), (6, talk(X.WARMUP_ASSISTANT, GOOD), ["x"], None), (7, None, ["x"], False)]
    kept, dropped = CA.split_runtime_invalid(spark.createDataFrame(rows, f"k long, prefix_messages {MESSAGES}, prefix_actions array<string>, is_raw_variant boolean"))
    assert sorted(x.k for x in kept.collect()) == [1, 4, 6, 7]
    got = {x.k: [tuple(z) for z in x.runtime_invalid_details] for x in dropped.collect()}
    assert got == {2: [(2, 1, "multiple_action_tags", 2), (3, 2, "missing_action_tag", 0), (4, 3, "empty_sanitized_action", 1)], 3: [(-1, -1, CA.NO_ACTIONS, 0)], 5: [(-1, -1, CA.NO_ACTIONS, 0)]}
    assert {x.k: x.runtime_invalid_reasons[0] for x in dropped.collect()}[3] == CA.NO_ACTIONS


def test_reparsed(spark):
    df = spark.createDataFrame([(1, talk("[[ Look ]] and Action: z", GOOD, TWO, NONE, X.WARMUP_ASSISTANT)), (2, []), (3, None), (4, [("assistant", None)])], f"k long, m {MESSAGES}")
    got = {x.k: x.r for x in df.select("k", CA.reparsed(F.col("m")).alias("r")).collect()}
    assert got[1].actions == ["look", "get 1 log", "b"] and got[1].summary.modes == {"bracket": 1, "line": 2}
    s = got[1].summary
    assert (s.turns, s.turns_without_warmup, s.missing, s.several, s.empty) == (5, 4, 1, 1, False)
    assert [(d.place, d.turn, d.is_warmup, d.tags, d.action, d["mode"]) for d in got[1].details] == [(1, 0, False, 1, "look", "bracket"), (2, 1, False, 1, "get 1 log", "line"), (3, 2, False, 2, "b", "line"), (4, 3, False, 0, None, None), (5, 4, True, 0, None, None)]
    assert got[2].summary.empty and got[3].details == [] and got[4].summary.missing == 1 and got[2].summary.modes == {}


def test_candidates_must_match_both_ways(spark):
    c = spark.createDataFrame([("s1", 1, "a"), ("s1", 1, "a"), ("s2", 2, "b")], "sample_uid string, task_id long, x string")
    t = spark.createDataFrame([("s1", 10), ("s2", 20), ("s2", 20), ("s9", 9)], "sample_uid string, x long")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "task_id long, y string")
    got = sorted(tuple(x) for x in CA.matched_candidates(c, t, b).collect())
    assert got == [("s1", 1, "a", 10, "p"), ("s1", 1, "a", 10, "p"), ("s2", 2, "b", 20, "q")]
    with pytest.raises(Exception, match="no teacher row for s2"):
        CA.matched_candidates(c, t.where("sample_uid = 's1'"), b).collect()
    with pytest.raises(Exception, match="no base row for 2"):
        CA.matched_candidates(c, t, b.where("task_id = 1")).collect()
    with pytest.raises(Exception, match="no teacher row for null"):
        CA.matched_candidates(c.withColumn("sample_uid", F.lit(None).cast("string")), t, b).collect()
    assert CA.matched_candidates(c.limit(0), t, b).count() == 0


DEMOS = "sample_uid string, k long, response_ids array<int>, attention array<int>, loss_mask array<double>, old_log_probs array<double>, reward double"


def test_demo_batch(spark):
    batch = spark.createDataFrame([("a", 0.2, True, "x"), ("a", 0.4, None, "RAW"), ("a", 9.0, False, "x"), ("b", 0.9, True, "x")], "sample_uid string, reward double, is_raw_variant boolean, variant_label string")
    means = CA.raw_reward_means(batch)
    assert {x.sample_uid: round(x.raw_mean, 6) for x in means.collect()} == {"a": 0.3, "b": 0.9}
    rows = [("a", 1, [5, 6, 7], [1, 1, 0], [0.0, 1.0, 0.0], [-1.0, -2.0, -3.0], 0.8), ("b", 2, [5], None, [1.0], [-1.0], 0.5), ("a", 3, [1] * 9, None, [1.0] * 9, [0.0] * 9, 1.0), ("z", 4, [1], None, [], [], 1.0), ("a", 5, [1], None, [1.0], [0.0], 7.0)]
    kept, counts = CA.demo_batch(spark.createDataFrame(rows, DEMOS), means, 4, 99, 0.5)
    got = {x.k: x for x in kept.collect()}
    assert tuple(counts.first()) == (5, 3, 1, 1) and sorted(got) == [1, 2, 5]
    x = got[1]
    assert x.responses == [5, 6, 7, 99] and x.response_attention == [1, 1, 0, 0] and x.response_mask == [0.0, 1.0, 0.0, 0.0] and x.old_log_probs == [-1.0, -2.0, -3.0, 0.0]
    assert x.token_scores == [0.0, 0.8, 0.0, 0.0] and x.advantages == pytest.approx([0.0, 0.25, 0.0, 0.0])
    assert got[2].advantage == 0.0 and got[5].advantage == 1.0
    for bad, message in ((("a", 1, [5, 6], None, [1.0], [0.0, 0.0], 1.0), "different lengths"), (("a", 1, [5], None, [0.0], [0.0], 1.0), "no token to learn"), (("a", 1, None, None, [1.0], [0.0], 1.0), "different lengths")):
        with pytest.raises(Exception, match=message):
            CA.demo_batch(spark.createDataFrame([bad], DEMOS), means, 4, 99)[0].collect()
    with pytest.raises(Exception, match="longer than the batch"):
        CA.demo_batch(spark.createDataFrame([rows[2]], DEMOS), means, 4, 99, skip_overlong=False)[0].collect()


def test_canonical_trajectory(spark):
    run = [("user", X.WARMUP_USER + " x"), ("assistant", X.WARMUP_ASSISTANT), ("tool", "t"), ("user", "Goal: craft lamp."), ("assistant", "Thought: hm\nAction: Get  1 log"), ("assistant", None)]
    x = CA.canonical_trajectory(spark.createDataFrame([("item_3", 2, run)], f"item_id string, sample_idx int, conversations {MESSAGES}"), "S").first()
    assert [(m.role, m.content) for m in x.canonical_messages] == [("system", "S"), ("user", "Goal: craft lamp."), ("assistant", "Think: hm\nAction: [[ Get 1 log ]]"), ("assistant", "")]
    assert x.goal == "lamp" and x.sample_uid == "item_3::2" and len(x.episode_messages) == 3
    for bad in ([], None, [("assistant", "a")], [("user", X.WARMUP_USER)]):
        with pytest.raises(Exception, match="no first user message"):
            CA.canonical_trajectory(spark.createDataFrame([("i", 1, bad)], f"item_id string, sample_idx int, conversations {MESSAGES}"), "S").collect()


def test_prompts_within_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    texts = ["", "a b c", "word " * 30, "é" * 40, "x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "k long, t string")
    for most in (0, 3, 30):
        want = [i for i, x in enumerate(texts) if len(t.encode(x, add_special_tokens=False).ids) <= most]
        assert sorted(x.k for x in CA.within_tokens(df, F.col("t"), path, most).collect()) == want


def test_manifests_and_reports_leave_nothing_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "MOST_VALUES", 5)
    assert len(T.write_with_manifest(spark.range(5), str(tmp_path / "a"), "id", "id")["counts"]) == 5
    with pytest.raises(ValueError, match="no column for a manifest"):
        T.write_with_manifest(spark.range(6), str(tmp_path / "b"), "id", "id")
    with pytest.raises(ValueError, match="over 3 rows"):
        T.report(spark.range(4), "x", 3)
    assert T.report(spark.range(3), "x", 3).count("\n") == 7
