"""The corpus pipeline: quality, toxicity, near copies, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm import minhash, packing, random_indexing, repeats, toxicity
from trajecta.llm.tables import cut, discard

#: Bytes of a passage that the fourth stage takes out where it repeats: about 40 words.
PASSAGE_BYTES = 200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more by the quality classifier, fitted on the labelled ones among them.

    Null, empty and very long texts, ties, repeated rows, empty tables and other
    columns: as ``random_indexing.keep_good`` says.
    """
    return random_indexing.keep_good(docs, _table(spark, sf_dir, "labels"), 0.3)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by the toxicity classifier, fitted on all labelled documents.

    Null, empty and very long texts, ties, repeated rows, empty tables and other
    columns: as ``toxicity.keep_clean`` says.
    """
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents"), 0.5)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the one of least doc_id.

    Null, empty and very long texts, ties, repeated rows, empty tables and other
    columns: as ``minhash.keep_one`` says.
    """
    return minhash.keep_one(docs, 5, 80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; every row stays.

    Null, empty and very long texts, ties, repeated rows, empty tables and other
    columns: as ``repeats.without_repeats`` says.
    """
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null, empty and very long texts, ties, repeated rows, empty tables and other
    columns: as ``packing.pack_documents`` says.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", distinct), ("repeats", passages), ("packing", sequences)]

#: Classifiers, components and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's table goes once the next one is written."""
    docs, spent = _table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if spent is not None:
            discard(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
