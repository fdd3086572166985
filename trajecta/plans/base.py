"""How a query is registered: beside the SQL that gives the same rows (none where SQL can't)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajecta.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For plans with Python workers."""
    ship(spark)
    return table(spark, sf_dir, name)


def parts_by_rows(df: DataFrame, rows: int = 250_000) -> int:
    """Partitions for a shuffle of a table: one for so many of its rows, so that tasks keep their size when it grows; no fewer than Spark's own."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def plan(plans: dict, sql: str | None = None):
    """Decorator: register the function under its name."""

    def put(f):
        plans[f.__name__] = (f, sql)
        return f

    return put
