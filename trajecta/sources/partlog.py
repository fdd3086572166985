"""A table written in parts, with a log of those that are finished, by version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from trajecta.sources.tables import cut


class PartLog:
    """Parts of one version under a folder.

    A part is written to a folder of its own; then a file in the log names it,
    put in place by one rename.  Only parts that the log of this version names
    are read: those of other versions, and those of jobs that failed before
    their rename, are not.  Of two jobs that finish the same part the first one
    counts, and the other's folder goes.
    """

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        path = self.hadoop.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def parts(self) -> dict[int, str]:
        """Finished parts of this version and their folders."""
        fs, log = self._at(f"log/{self.version}")
        if not fs.exists(log):
            return {}
        names = [x.getPath().getName() for x in fs.listStatus(log) if x.getPath().getName().endswith(".json")]
        if not names:
            return {}
        lines = self.spark.read.text([f"{self.path}/log/{self.version}/{n}" for n in names]).collect()
        return {x["part"]: x["folder"] for x in (json.loads(line.value) for line in lines)}

    def write(self, rows: DataFrame, part: int) -> bool:
        """Write a part and log it; false if another job has finished it before."""
        folder = f"parts/{self.version}/part={part:05d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        fs, tmp = self._at(f"log/{self.version}/_{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray((json.dumps({"part": part, "folder": folder}) + "\n").encode()))
        out.close()
        fs, log = self._at(f"log/{self.version}/{part:05d}.json")
        if not fs.exists(log) and fs.rename(tmp, log):
            return True
        fs.delete(tmp, False)
        fs.delete(self.hadoop.Path(f"{self.path}/{folder}"), True)
        return False

    def read(self, schema=None) -> DataFrame | None:
        """The rows of all finished parts; None if there are none and no schema is given."""
        folders = [f"{self.path}/{x}" for _, x in sorted(self.parts().items())]
        if not folders:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*folders)

    def append(self, rows: DataFrame, key: str) -> int:
        """Write the rows whose key no finished part of this version holds as the next part; how many those are."""
        done = self.read()
        fresh = cut(rows if done is None else rows.join(done.select(key), key, "left_anti"))
        n = fresh.count()
        while n and not self.write(fresh, max(self.parts(), default=-1) + 1):
            fresh = cut(fresh.join(self.read().select(key), key, "left_anti"))
            n = fresh.count()
        return n
