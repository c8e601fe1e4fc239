"""Registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nametwin.llm import (
    op1_records,
    op2_dedup,
    op3_embeddings,
    op4_simhash,
    op5_privacy,
    op6_mixing,
    op7_substrings,
    op8_passages,
    op9_packing,
    op10_langid,
    op11_periods,
    op12_search,
    op13_trie,
)
from nametwin.llm.common import table
from nametwin.llm.oracle import ORACLES
from nametwin.operators.keep import scratch_folder


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as framed token ids, written and read back."""
    folder = scratch_folder(spark)
    docs = table(spark, sf_dir, "documents")
    manifest = op1_records.write_records(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return op1_records.read_records(spark, folder, manifest)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    groups = op2_dedup.dedup_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of a label at cosine 0.98."""
    found = op3_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their components at 4 bits."""
    found = op4_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document and the terms that disclose it."""
    return op5_privacy.report(op5_privacy.private_spans(table(spark, sf_dir, "documents")))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    return op6_mixing.taken_words(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without bytes of any 200-byte string that occurs twice."""
    found = op7_substrings.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without words of any 20-word window that occurs earlier."""
    found = op8_passages.first_only(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    return op9_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return op10_langid.languages(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which are given one."""
    docs = op11_periods.with_cycles(table(spark, sf_dir, "documents"))
    return op11_periods.periodic_runs(docs, digest=True)


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return op12_search.top_products(vectors, F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations, each opened as the first of its twenty."""
    return op13_trie.trie(op13_trie.shared_openings(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_records,
        op2_exact_dedup,
        op3_embedding_dedup,
        op4_simhash_dedup,
        op5_private_spans,
        op6_mix_sources,
        op7_substring_dedup,
        op8_passage_dedup,
        op9_pack_sequences,
        op10_language_id,
        op11_periodic_runs,
        op12_top_products,
        op13_prefix_trie,
    )
} | {"pipeline": corpus_pipeline.run}

__all__ = ["ORACLES", "QUERIES"]
