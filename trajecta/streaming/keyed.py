"""Sessions with keyed state and timers, and a table of running baselines that is merged on read."""

from __future__ import annotations

import contextlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, IntegralType, NumericType, StringType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class _Sessions(StatefulProcessor):
    """The open runs of a bucket of keys: a list state with a row for each, and a timer for the first of their ends."""

    def __init__(self, close: str, idle_us: int, every: int, by_clock: bool, ttl_ms: int | None, buckets: int):
        self.close_kind, self.idle, self.every, self.by_clock, self.ttl, self.buckets = close, idle_us, every, by_clock, ttl_ms, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.ttl} if self.ttl else {}
        self.open = handle.getListState("open", "buckets int, key string, n long, total double, last long, ends long, kinds map<string,long>", **ttl)

    def _now(self, timer_values) -> int:
        return timer_values.getCurrentProcessingTimeInMs() if self.by_clock else timer_values.getCurrentWatermarkInMs()

    def _wait(self) -> int:
        return self.idle // 1000 + 1

    def _read(self, now: int) -> tuple[dict, int | None]:
        """Runs by key, and the timer that stands for them."""
        rows = list(self.open.get())
        if any(x[0] != self.buckets for x in rows):
            raise ValueError("the checkpoint was made with another number of buckets")
        # rows of a bucket are written together, so their own time to live is kept here
        runs = {x[1]: tuple(x[2:]) for x in rows if not self.ttl or x[5] - self._wait() + self.ttl > now}
        return runs, min((x[5] for x in rows), default=None)

    def _write(self, runs: dict, timer: int | None) -> None:
        if runs:
            self.open.put([(self.buckets, k, *x) for k, x in runs.items()])
        else:
            self.open.clear()
        first = min((x[3] for x in runs.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self._now(timerValues)
        pdf = pd.concat(list(rows)).sort_values(["at", "order"], kind="stable")
        runs, timer = self._read(now)
        for k, at, kind, x in zip(*(pdf[c].tolist() for c in ("key", "at", "kind", "value")), strict=True):
            k = None if k != k else k  # a null among texts
            n, total, last, _, kinds = runs.pop(k, (0, 0.0, 0, 0, {}))
            if n and at - last > self.idle:
                out.append((k, "expired", n, total, kinds))
                n, total, kinds = 0, 0.0, {}
            n, total = n + 1, total + (0.0 if x is None or x != x else float(x))
            kinds[str(kind)] = kinds.get(str(kind), 0) + 1
            if kind == self.close_kind:
                out.append((k, "closed", n, total, kinds))
                continue
            if n % self.every == 0:
                out.append((k, "every", n, total, dict(kinds)))
            runs[k] = (n, total, at, (now if self.by_clock else at // 1000) + self._wait(), kinds)
        self._write(runs, timer)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        runs, timer = self._read(now)
        ended = {k: x for k, x in runs.items() if x[3] <= now}
        # Spark takes away the timer that has fired
        self._write({k: x for k, x in runs.items() if k not in ended}, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if ended:
            yield _frame([(k, "expired", n, total, kinds) for k, (n, total, _, _, kinds) in ended.items()])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "reason", "n", "total", "kinds"])


def keyed_sessions(events: DataFrame, key: str, at: str, order: str, kind: str, value: str, close: str = "logout", idle: str = "30 minutes", every: int = 100, late: str = "10 minutes", by_clock: bool = False, ttl: str | None = None, buckets: int = 1024) -> DataFrame:
    """A stream's sessions: (key, reason, n, total, kinds), a row whenever one closes, expires, or has grown by ``every`` events.

    A session ends with an event of the kind ``close`` or after ``idle`` without
    one: when a later event comes, or by a timer once the watermark (``late``
    behind) has passed its end.  With ``by_clock`` timers go by the machine's
    clock instead, and state that was not written for ``ttl`` is dropped.  A
    key's next event begins a new session, with nothing kept of the one before.
    Rows of a micro-batch are taken in the order of ``at`` and ``order``.  Null
    values count 0.  Rows with a null key are one key; rows with a null time are
    left out; a time without a zone is one of the session's.

    Keys, which are numbers, texts, dates or booleans, are dealt by hash into
    ``buckets``, as a call of the processor, its state and its answer cost far
    more than a key's few events.  A bucket's rows of one micro-batch, and its
    open sessions, are in memory at once.  The number of buckets stays as it is
    for the life of a checkpoint.
    """
    ms = lambda x: int(pd.Timedelta(x).total_seconds() * 1000)
    if ttl and not by_clock:
        raise ValueError("a time to live goes with the clock")
    kind_of = events.schema[key].dataType
    if not isinstance(kind_of, NumericType | StringType | DateType | BooleanType):
        raise ValueError(f"a key of type {kind_of.simpleString()}")
    # the driver's own Python runner does not see shipped files
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    processor = _Sessions(close, ms(idle) * 1000, every, by_clock, ms(ttl) if ttl else None, buckets)
    # a null among whole numbers would make them fractions in pandas
    placed = F.coalesce(F.col(order).cast("long"), F.lit(2**63 - 1)) if isinstance(events.schema[order].dataType, IntegralType) else F.col(order)
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("time"), placed.alias("order"), F.col(kind).alias("kind"), F.col(value).alias("value")).where("time is not null")
    rows = rows if by_clock else rows.withWatermark("time", late)
    whole = F.col("key") + 0.0 if isinstance(kind_of, FloatType | DoubleType) else F.col("key")
    bucket = F.pmod(F.xxhash64(whole), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, whole.cast("string").alias("key"), "time", F.unix_micros("time").alias("at"), "order", "kind", "value")
    out = "key string, reason string, n long, total double, kinds map<string,long>"
    found = rows.groupBy("bucket").transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if by_clock else "EventTime")
    return found.withColumn("key", F.col("key").cast(kind_of))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under a path, in order; none if there is no such path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


class BaselineTable:
    """The latest mean of each key, kept as bases and deltas that are merged when they are read.

    A micro-batch writes its own keys, a file for each bucket at most.  Every
    ``compact_every`` deltas a new base is written from the one before and the
    deltas since; the base before it stays for those who still read it, and what
    is older goes.  A batch that runs again after a failure writes the same
    folder again, and folders that were not finished are not read.
    """

    def __init__(self, path: str, key: str, value: str, buckets: int = 8, compact_every: int = 16):
        self.path, self.key, self.value, self.buckets, self.compact_every = path, key, value, buckets, compact_every

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        """Epochs whose folder is finished."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        found = []
        for name in _folders(spark, f"{self.path}/{kind}"):
            mark = hadoop.Path(f"{self.path}/{kind}/{name}/_SUCCESS")
            if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.select(self.key, "mean", "epoch").repartition(self.buckets, bucket).write.mode("overwrite").parquet(f"{self.path}/{kind}/epoch={epoch:012d}")

    def _merged(self, spark: SparkSession, last: int | None = None) -> DataFrame | None:
        bases = [e for e in self._done(spark, "base") if last is None or e <= last]
        base = bases[-1] if bases else -1
        deltas = [e for e in self._done(spark, "delta") if e > base and (last is None or e <= last)]
        folders = [f"{self.path}/base/epoch={base:012d}"] * (base >= 0) + [f"{self.path}/delta/epoch={e:012d}" for e in deltas]
        if not folders:
            return None
        rows = spark.read.schema(self.schema).parquet(*folders)
        return rows.groupBy(self.key).agg(F.max_by(F.struct("mean", "epoch"), "epoch").alias("x")).select(self.key, "x.mean", "x.epoch")

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        """A ``foreachBatch`` function."""
        rows = batch.groupBy(self.key).agg(F.avg(self.value).cast("double").alias("mean")).withColumn("epoch", F.lit(epoch).cast("long"))
        self.schema = rows.schema
        self._write(rows, "delta", epoch)
        spark = batch.sparkSession
        bases = self._done(spark, "base")
        since = [e for e in self._done(spark, "delta") if e > (bases[-1] if bases else -1) and e <= epoch]
        if len(since) >= self.compact_every:
            self.compact(spark, epoch)

    def compact(self, spark: SparkSession, epoch: int) -> None:
        """A base of all up to ``epoch``; bases before the last one, and deltas that it holds, go."""
        rows = self._merged(spark, epoch)
        if rows is None:
            return
        before = self._done(spark, "base")
        self._write(rows, "base", epoch)
        keep = before[-1] if before else -1
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for kind in ("base", "delta"):
            for e in self._done(spark, kind):
                if e < keep or kind == "delta" and e == keep:
                    at = hadoop.Path(f"{self.path}/{kind}/epoch={e:012d}")
                    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def read(self, spark: SparkSession, key_type: str | None = None) -> DataFrame:
        """(key, mean) of all batches so far; ``key_type`` is needed by a reader that has written nothing."""
        if key_type:
            self.schema = spark.createDataFrame([], f"{self.key} {key_type}, mean double, epoch long").schema
        rows = self._merged(spark)
        return spark.createDataFrame([], self.schema).select(self.key, "mean") if rows is None else rows.select(self.key, "mean")
