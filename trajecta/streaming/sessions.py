"""Structured Streaming: keyed sessions with state, running baselines and windowed extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_totals(events: DataFrame, key: str = "user_id", value: str = "value", close_type: str = "logout", max_rounds: int = 1_000_000) -> DataFrame:
    """(key, n, total, done) after each micro-batch; ``done`` is sticky once a closing event or the last round came."""

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, done = state.get if state.exists else (0, 0.0, False)
        for pdf in parts:
            pdf = pdf.sort_values("event_id")
            for x, kind in zip(pdf[value].tolist(), pdf["event_type"].tolist(), strict=True):
                if done:
                    break
                n, total = n + 1, total + float(x)
                done = kind == close_type or n >= max_rounds
        state.update((n, total, done))
        yield pd.DataFrame([(k[0], n, total, done)], columns=[key, "n", "total", "done"])

    out = f"{key} long, n long, total double, done boolean"
    return events.groupBy(key).applyInPandasWithState(step, out, "n long, total double, done boolean", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: counts and sums by event-time window and type, with a watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def upsert_baselines(path: str, key: str, value: str):
    """foreachBatch writer: the latest mean of each key over all batches, as a new version folder for each batch.

    A batch that runs again after a failure writes the same version again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.avg(value).alias("mean"))
        if epoch:
            old = spark.read.parquet(f"{path}/v={epoch - 1}")
            fresh = old.join(fresh, key, "left_anti").select(key, "mean").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def replay_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet parts as a stream, a few files at a time; growing the folder grows the stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
