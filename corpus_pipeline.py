"""Pipeline from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages rows are
written as Parquet and read again. All stages but the last return the columns of
`documents`; rows alike in all columns are documents of their own. Null ids, null texts,
empty texts and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nametwin.llm import op2_dedup, op4_simhash, op6_mixing, op9_packing, op10_langid
from nametwin.llm.common import table
from nametwin.operators.keep import settle

MIN_SCORE = 0.3  # a text of which no language reaches this share is rejected
KNOWN_WORDS = 100_000  # that a worker remembers; it also holds what earlier stages left


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whose words agree on a language at least this far."""
    return op10_langid.recognised(docs, MIN_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return op2_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints links lead through: four-word shingles, four bits."""
    return op4_simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not, once or twice."""
    return op6_mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return op9_packing.pack_documents(docs, path, entries=KNOWN_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None  # a learned model and tokenizer ids are beyond SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
