"""A batch loader that goes on where it stopped, and samplers that learn from batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators.batch import with_ordinal


class CurriculumSampler:
    """Hook: ``order`` gives the order of rows in an epoch, ``update`` sees each batch that was used."""

    def order(self, epoch: int) -> Column:
        raise NotImplementedError

    def update(self, batch: DataFrame) -> None:
        raise NotImplementedError


class HashSampler(CurriculumSampler):
    """Every epoch in an order of its own by hash of the key; batches change nothing."""

    def __init__(self, key: str, seed: int = 0):
        self.key, self.seed = key, seed

    def order(self, epoch: int) -> Column:
        return F.md5(F.concat_ws(":", F.lit(self.seed), F.lit(epoch), F.col(self.key).cast("string")).cast("binary"))

    def update(self, batch: DataFrame) -> None:
        pass


class BatchLoader:
    """Batches of a table, epoch after epoch, with the place kept in a folder that a new loader goes on from.

    An epoch's order is made once and written to the folder; a batch is a range
    of it.  The place is written after ``done``, so a batch whose work failed
    comes again.
    """

    def __init__(self, df: DataFrame, folder: str, size: int, sampler: CurriculumSampler, drop_last: bool = True):
        self.df, self.folder, self.size, self.sampler, self.drop_last = df, folder, size, sampler, drop_last
        self.spark = df.sparkSession
        self.epoch, self.place = self._saved()
        self.rows = df.count()

    def _saved(self) -> tuple[int, int]:
        try:
            x = json.loads(self.spark.read.text(f"{self.folder}/place").collect()[0]["value"])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, 0
        return x["epoch"], x["place"]

    def _epoch(self) -> DataFrame:
        path = f"{self.folder}/epoch={self.epoch}"
        try:
            return self.spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        with_ordinal(self.df.withColumn("_o", self.sampler.order(self.epoch)), ["_o", *self.df.columns[:1]], "_at").drop("_o").write.parquet(path)
        return self.spark.read.parquet(path)

    def batch(self) -> DataFrame | None:
        """The rows of the next batch; None after the last of an epoch."""
        left = self.rows - self.place
        if left <= 0 or (left < self.size and self.drop_last):
            return None
        at = F.col("_at")
        return self._epoch().where((at >= self.place) & (at < self.place + self.size)).drop("_at")

    def done(self) -> None:
        """The batch was used: the sampler sees it, and the place is written."""
        used = self.batch()
        if used is not None:
            self.sampler.update(used)
        self.place += self.size
        self._save()

    def next_epoch(self) -> None:
        self.epoch, self.place = self.epoch + 1, 0
        self._save()

    def _save(self) -> None:
        text = json.dumps({"epoch": self.epoch, "place": self.place})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/place")


def run_epochs(loader: BatchLoader, epochs: int, work: Callable[[int, DataFrame], None]) -> int:
    """``work(epoch, batch)`` for every batch up to so many epochs; returns the number of batches."""
    n = 0
    while loader.epoch < epochs:
        while (b := loader.batch()) is not None:
            work(loader.epoch, b)
            loader.done()
            n += 1
        loader.next_epoch()
    return n
