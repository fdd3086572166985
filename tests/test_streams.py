"""Keyed sessions with timers, and baselines merged on read."""

import os
import random
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from trajecta.streaming import keyed

EVENTS = "user_id long, ts timestamp, event_id long, event_type string, value double"
ZERO = datetime(2024, 1, 1)


def plain_sessions(rows, close, idle, every, end):
    """Rows of all sessions; those still open at ``end`` expire if their last event is longer ago."""
    out, open_ = [], {}
    for user, at, _, kind, x in sorted(rows, key=lambda r: (r[1], r[2])):
        n, total, last, kinds = open_.pop(user, (0, 0.0, None, {}))
        if n and at - last > idle:
            out.append((user, "expired", n, total, kinds))
            n, total, kinds = 0, 0.0, {}
        n, total, kinds = n + 1, total + (x or 0.0), kinds | {kind: kinds.get(kind, 0) + 1}
        if kind == close:
            out.append((user, "closed", n, total, kinds))
            continue
        if n % every == 0:
            out.append((user, "every", n, total, kinds))
        open_[user] = (n, total, at, kinds)
    out += [(u, "expired", n, total, k) for u, (n, total, last, k) in open_.items() if end - last > idle]
    return ordered(out)


def ordered(rows):
    return sorted(((*x[:4], tuple(sorted(x[4].items()))) for x in rows), key=repr)


def made_events(r, n):
    at, rows = ZERO, []
    for i in range(n):
        at += timedelta(seconds=r.choice([1, 20, 200]))
        rows.append((r.choice([1, 1, 1, 2, 3]), at, i, r.choice(["view", "click", "logout"] if r.random() < 0.3 else ["view"]), r.choice([None, 1.0, 2.5])))
    return rows


def test_sessions_over_restarts(spark, tmp_path):
    r = random.Random(4)
    rows = made_events(r, 240)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        part = rows[80 * k : 80 * (k + 1)]
        if k == 2:
            part = [*part, (9, part[-1][1] + timedelta(hours=2), 999, "view", 1.0)]  # moves the watermark past all others
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        with keyed.rocks(spark):  # a new query on the same checkpoint each time
            stream = spark.readStream.schema(EVENTS).parquet(src)
            q = keyed.keyed_sessions(stream, "user_id", "ts", "event_id", "event_type", "value", idle="5 minutes", every=4, late="1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
            q.awaitTermination(300)
            assert q.exception() is None
    got = ordered((x.key, x.reason, x.n, x.total, x.kinds) for x in spark.read.parquet(out).collect())
    end = rows[-1][1] + timedelta(hours=2) - timedelta(minutes=1)
    assert got == plain_sessions([*rows, (9, end + timedelta(minutes=1), 999, "view", 1.0)], "logout", timedelta(minutes=5), 4, end)
    assert {x[1] for x in got} == {"closed", "every", "expired"}
    assert keyed.PROVIDER not in {k for k, _ in spark.sparkContext.getConf().getAll()}


def test_sessions_by_the_clock(spark, tmp_path):
    with pytest.raises(ValueError):
        keyed.keyed_sessions(spark.createDataFrame([], EVENTS), "user_id", "ts", "event_id", "event_type", "value", ttl="1 hour")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, ZERO, 1, "view", 1.0), (1, ZERO, 2, "view", 2.0)], EVENTS).coalesce(1).write.parquet(src)
    with keyed.rocks(spark):
        stream = spark.readStream.schema(EVENTS).parquet(src)
        q = keyed.keyed_sessions(stream, "user_id", "ts", "event_id", "event_type", "value", idle="3 seconds", by_clock=True, ttl="1 hour").writeStream.format("memory").queryName("by_clock").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            for _ in range(60):
                if got := spark.table("by_clock").collect():
                    break
                time.sleep(1)
        finally:
            q.stop()
    assert [(x.key, x.reason, x.n, x.total, x.kinds) for x in got] == [(1, "expired", 2, 3.0, {"view": 2})]


def test_sessions_cost_a_call_for_a_bucket_and_not_for_a_key(spark, tmp_path, monkeypatch):
    src, calls, inner = str(tmp_path / "in"), str(tmp_path / "calls"), keyed._Sessions.handleInputRows

    def counted(self, key, rows, timer_values):
        with open(calls, "a") as f:
            f.write("x")
        yield from inner(self, key, rows, timer_values)

    monkeypatch.setattr(keyed._Sessions, "handleInputRows", counted)
    rows = [(k, ZERO + timedelta(minutes=m), 2 * k + m // 9, "logout" if k % 3 == 0 and m else "view", float(k)) for k in range(1500) for m in (0, 9)]
    end = ZERO + timedelta(days=1)
    spark.createDataFrame([*rows, (-1, end, 9999, "view", None)], EVENTS).coalesce(1).write.parquet(src)
    with keyed.rocks(spark):
        q = keyed.keyed_sessions(spark.readStream.schema(EVENTS).parquet(src), "user_id", "ts", "event_id", "event_type", "value", late="1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(300)
    got = ordered((x.key, x.reason, x.n, x.total, x.kinds) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain_sessions(rows, "logout", timedelta(minutes=30), 100, end)
    assert os.path.getsize(calls) <= 1024 < 1500


def test_keys_of_a_bucket_stay_apart(spark, tmp_path):
    """A null beside numbers that a double can't tell apart, in a night when the session's clock goes back an hour."""
    src, out, keys = str(tmp_path / "in"), str(tmp_path / "out"), [None, 2**53, 2**53 + 1, -5]
    r, at, rows = random.Random(8), datetime(2024, 11, 3, 4, 30, tzinfo=timezone.utc), []
    for i in range(90):
        at += timedelta(seconds=r.choice([1, 60, 400]), microseconds=r.choice([0, 300]))
        rows.append((r.choice(keys), at, None if i % 9 == 0 else 2**53 + i, r.choice(["view", "view", "click", "logout"]), r.choice([None, 1.0, 2.5])))
    end = at + timedelta(hours=3)
    zone = spark.conf.get("spark.sql.session.timeZone")

    def run(part, buckets):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        with keyed.rocks(spark):
            q = keyed.keyed_sessions(spark.readStream.schema(EVENTS).parquet(src), "user_id", "ts", "event_id", "event_type", "value", idle="8 minutes", every=4, late="1 minute", buckets=buckets).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
            q.awaitTermination(300)

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        run(rows[:40], 1)
        run([*rows[40:], (7, end, 999, "view", None)], 1)
        got = ordered((x.key, x.reason, x.n, x.total, x.kinds) for x in spark.read.parquet(out).collect())
        with pytest.raises(Exception, match="another number of buckets"):
            run([(k, end + timedelta(minutes=1), 1000, "view", None) for k in range(40)], 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == plain_sessions(rows, "logout", timedelta(minutes=8), 4, end)
    with pytest.raises(ValueError):
        keyed.keyed_sessions(spark.createDataFrame([], "k array<int>, ts timestamp, i int, e string, v double"), "k", "ts", "i", "e", "v")


def files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, xs in os.walk(path) for x in xs if x.startswith("part-")}


def test_baselines_write_their_own_keys(spark, tmp_path):
    r, path = random.Random(6), str(tmp_path / "base")
    table, want = keyed.BaselineTable(path, "k", "v", buckets=3, compact_every=4), {}
    assert table.read(spark, "long").collect() == []
    for epoch in range(11):
        rows = [(r.randint(0, 60), float(r.randint(0, 9))) for _ in range(r.choice([1, 5, 20]))] + [(None, 1.0)]
        batch = spark.createDataFrame(rows, "k long, v double")
        before = files(path)
        table.upsert(batch, epoch)
        if epoch % 3 == 0:
            table.upsert(batch, epoch)  # the batch again, after a failure
        after = files(path)
        touched = [f for f in after if before.get(f) != after[f] and "/delta/" in f]
        assert 1 <= len(touched) <= 3
        for k in {k for k, _ in rows}:
            mine = [v for x, v in rows if x == k]
            want[k] = sum(mine) / len(mine)
        got = {x.k: x["mean"] for x in table.read(spark).collect()}
        assert got == pytest.approx(want)
    os.makedirs(f"{path}/delta/epoch={99:012d}")  # begun, not finished
    assert {x.k: x["mean"] for x in keyed.BaselineTable(path, "k", "v").read(spark, "long").collect()} == pytest.approx(want)
    assert len(os.listdir(f"{path}/delta")) <= 2 * 4 + 2 and len(os.listdir(f"{path}/base")) <= 2


def test_baselines_of_a_stream(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "base")
    for k in range(3):
        spark.createDataFrame([(i % 4, float(10 * k + i)) for i in range(8 if k < 2 else 1)], "k long, v double").coalesce(1).write.mode("append").parquet(src)
        table = keyed.BaselineTable(path, "k", "v")
        q = spark.readStream.schema("k long, v double").parquet(src).writeStream.foreachBatch(table.upsert).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    got = {x.k: x["mean"] for x in keyed.BaselineTable(path, "k", "v").read(spark, "long").select("k", F.round("mean", 3).alias("mean")).collect()}
    assert got == {0: 20.0, 1: 13.0, 2: 14.0, 3: 15.0}
