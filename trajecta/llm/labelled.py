"""Training rows for the classifiers: labelled documents outside the held-out fold, in bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.ship import ship

FOLDS = 5
#: Bound of the labelled rows that a classifier is fitted on (expected size of the sample).
SAMPLE_ROWS = 6_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 0 modulo 5; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", bound: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of labelled rows outside the held-out fold, about ``bound`` of them, in one partition.

    The table is read by as many tasks as it has partitions; only the bounded
    sample is shuffled into one.  Rows with a null id or label are left out; of several labels for one id the
    largest counts.  The sample is by hash of the id, so runs agree.
    """
    y = labels.select(F.col("doc_id").alias("d"), F.col(label).cast("int").alias("y")).where(F.col("d").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("d"))).groupBy("d").agg(F.max("y").alias("y"))
    n = y.count()
    if n > bound:
        y = y.where(F.pmod(F.xxhash64("d"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    rows = docs.select(docs[doc_id].alias("d"), docs[text].alias("text"))
    return rows.join(y, "d").select("d", F.coalesce("text", F.lit("")).alias("text"), "y").repartition(1).sortWithinPartitions("d", "text")


def fit_in_task(rows: DataFrame, fit) -> bytes:
    """Run ``fit(texts, labels)`` in one task; it returns the model as bytes."""
    import pyarrow as pa

    ship(rows.sparkSession)

    def run(batches):
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(texts, ys)], pa.binary())], names=["model"])

    got = rows.select("text", "y").mapInArrow(run, "model binary").collect()
    return bytes(got[0]["model"]) if got else fit([], [])  # no labelled rows: no task ran
