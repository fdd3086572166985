"""Tables in and out: scans, tolerant JSON lines, resumable part sinks, manifests and wide metric files."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}
#: Values of the column that a manifest counts.
MOST_VALUES = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without that setting has a folder of its own, a cluster must name one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="trajecta-")
    return _own[app]


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: fixes what depends on partitions, and lost executors cost no more than a task."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/trajecta/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._trajecta_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._trajecta_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Files or globs as one table; only the named columns are read."""
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


def read_shards(spark: SparkSession, glob: str, key: str, version: str, order: list[str]) -> DataFrame:
    """All shards, one row for each key (first by order); several versions in one table raise."""
    df = spark.read.parquet(glob)
    n = df.agg(F.count_distinct(version).alias("_v"))
    df = df.join(F.broadcast(n)).where(F.when(F.col("_v") > 1, F.raise_error(F.lit("shards of different versions")).cast("boolean")).otherwise(F.lit(True))).drop("_v")
    return keep_first(df, [key], order)


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that could not be read; blank lines are neither."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = StructType([*schema.fields]).add("_corrupt_record", "string")
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    df = cut(df)  # the corrupt column can't be queried alone on the raw file
    return df.where("_corrupt_record is null").drop("_corrupt_record"), df.where("_corrupt_record is not null").select("_corrupt_record")


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that is one JSON object keyed by id."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str], order: list[str]) -> DataFrame:
    df = spark.read.schema(schema).option("header", "true").csv(path)
    if missing := set(required) - set(df.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df.dropna(subset=required).orderBy(*order)


def write_with_manifest(df: DataFrame, path: str, key: str, count: str, overwrite: bool = False, extra: dict | None = None) -> dict:
    """Write a table and, beside it, a JSON manifest with rows, distinct keys and counts of one column's values (over MOST_VALUES of them raise)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    n = back.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).collect()[0]
    values = back.groupBy(count).count()
    by = {str(r[count]): r["count"] for r in values.orderBy(F.desc("count"), count).limit(MOST_VALUES + 1).collect()}
    if len(by) > MOST_VALUES:
        raise ValueError(f"{count} has over {MOST_VALUES} values: no column for a manifest")
    manifest = {"path": path, "rows": n["rows"], "unique_keys": n["keys"], "counts": by} | (extra or {})
    text = json.dumps(manifest, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".manifest")
    return manifest


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append only the rows whose key the table does not hold yet; a restart goes on where it stopped."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], StructType([df.schema[key]]))
    fresh = cut(df.join(done, key, "left_anti"))
    fresh.write.mode("append").parquet(path)


def write_generations(df: DataFrame, path: str, step: str) -> None:
    """JSON lines, a folder for each step."""
    df.write.mode("append").partitionBy(step).json(path)


def write_metrics(long: DataFrame, path: str) -> None:
    """(step, key, value) as one wide CSV; keys become columns (a few hundred)."""
    keys = [r["key"] for r in long.select("key").distinct().orderBy("key").collect()]
    long.groupBy("step").pivot("key", keys).agg(F.first("value")).orderBy("step").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def report(summary: DataFrame, title: str, limit: int = 200) -> str:
    """A summary table of at most ``limit`` rows as Markdown; a longer one raises."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of over {limit} rows")
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows) + "\n"


def save_batch(df: DataFrame, path: str, name: str, meta: dict | None = None) -> None:
    """A named batch: its rows, and beside them its columns and what else is known of it as JSON."""
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    info = json.dumps({"name": name, "columns": df.columns, "meta": meta or {}}, sort_keys=True)
    df.sparkSession.createDataFrame([(info,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}.meta")


def load_batch(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, dict]:
    """The rows of a named batch with their columns in the order that they had, and its metadata."""
    info = json.loads(spark.read.text(f"{path}/{name}.meta").collect()[0]["value"])
    return spark.read.parquet(f"{path}/{name}").select(*info["columns"]), info["meta"]


def append_records(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines: a job adds files of its own, so jobs that write at once don't meet, and one that fails leaves nothing."""
    df.write.mode("append").json(path)
