"""A corpus pipeline over `documents`: each stage works on what the one before has kept.

A stage is a function of (spark, docs, sf_dir); all but the last return rows with
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import exact_dedup, language_id, near_dedup, packing, pii
from ledgerline.llm.catalog import table, vocabulary
from ledgerline.llm.common import materialize

#: Chunks whose ids a worker keeps while it packs: less than alone, as the workers and the JVM hold what earlier stages took.
KEPT_CHUNKS = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter; the classifier learns from the stage's own input."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the least doc_id stays."""
    return near_dedup.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets; no row goes."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their ids, each with its sequence and place in it."""
    return packing.assign(packing.pieces(docs, vocabulary("word_bpe_49k.json"), kept=KEPT_CHUNKS))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("pii", mask_personal_data), ("packing", pack_sequences)]

#: Classifiers, alignments and tokenizers are not SQL; tests/llm/test_pipeline.py goes through the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
