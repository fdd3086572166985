"""Sinks, tolerant readers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from trajecta.sources import tables as T
from trajecta.streaming import sessions


def test_jsonl_skips_bad_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    good, bad = T.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1


def test_json_documents(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"k1": ["x"], "k2": []}))
    got = {r["key"]: r["value"] for r in T.read_json_map(spark, str(tmp_path / "m.json"), "array<string>").collect()}
    assert got == {"k1": ["x"], "k2": []}


def test_append_missing_resumes(spark, tmp_path):
    path = str(tmp_path / "t")
    T.append_missing(spark.range(3), path, "id")
    T.append_missing(spark.range(5), path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_manifest_and_refusal(spark, tmp_path):
    df = spark.range(4).withColumn("kind", F.col("id") % 2)
    m = T.write_with_manifest(df, str(tmp_path / "t"), "id", "kind")
    assert m["rows"] == 4 and m["counts"] == {"0": 2, "1": 2}
    with pytest.raises(Exception, match="exists"):
        T.write_with_manifest(df, str(tmp_path / "t"), "id", "kind")


def test_shards_of_two_versions_raise(spark, tmp_path):
    for i, v in enumerate("ab"):
        spark.createDataFrame([(1, v)], "k int, v string").write.parquet(str(tmp_path / f"s{i}.parquet"))
    with pytest.raises(Exception, match="versions"):
        T.read_shards(spark, str(tmp_path / "*.parquet"), "k", "v", ["k"]).collect()


def test_streams(spark, tmp_path, sf):
    from pyspark.sql.streaming.state import GroupState  # noqa: F401

    src = str(tmp_path / "in")
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(src)
    stream = sessions.replay_stream(spark, src, e.schema, 1)
    q = sessions.session_totals(stream).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.sql("select sum(n) s from (select user_id, max(n) n from totals group by 1)").collect()[0]["s"]
    assert n == e.count()
    q = sessions.windowed(sessions.replay_stream(spark, src, e.schema, 10)).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from win").collect()[0]["s"] == e.count()
    q = stream.writeStream.foreachBatch(sessions.upsert_baselines(str(tmp_path / "base"), "user_id", "value")).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "base/v=2")).count() == e.select("user_id").distinct().count()
