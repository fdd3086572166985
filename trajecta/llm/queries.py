"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajecta.llm.oracles import ORACLES  # noqa: F401
from trajecta.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.random_indexing import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.multiset_hash import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all conversations, laid out as transcripts, parsed back; ``role`` is what the table has."""
    from trajecta.llm.chat_hmm import as_transcript, parse_blocks

    return parse_blocks(as_transcript(table(spark, sf_dir, "conversations")))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.repeats import removed_digest

    return removed_digest(table(spark, sf_dir, "documents"))


def op5_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trajecta.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trajecta.llm.bpe_tree import encode_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trajecta.llm.residual_packing import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.changepoints import change_points

    return change_points(table(spark, sf_dir, "sale_lines").where("flag = 'kept'"))


def op13_errata_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajecta.llm.errata_trie import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op8_quality": op8_quality,
    "op2_multiset_fingerprint": op2_multiset_fingerprint,
    "op3_chat_hmm": op3_chat_hmm,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_cost_balanced_packing": op5_cost_balanced_packing,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_license_patience": op7_license_patience,
    "op9_pivot_index": op9_pivot_index,
    "op10_circulant_minhash": op10_circulant_minhash,
    "op11_residual_packing": op11_residual_packing,
    "op12_change_points": op12_change_points,
    "op13_errata_variants": op13_errata_variants,
}
