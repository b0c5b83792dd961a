"""A corpus pipeline over ``documents``: identify, filter, deduplicate, pack.

Every stage is a function of (spark, docs, sf_dir) over all rows its predecessor
kept.  Its result is written as Parquet to the shared folder and read again as
the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, language, packing, simhash, toxicity
from palimpsest.llm.common import discard, residue, swept, table, written
from palimpsest.llm.tokens import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is identified with a score of at least 0.5."""
    model = language.train(docs, residue(F.col("doc_id"), 3) != 1)
    return language.keep_identified(docs, model) if model.languages else docs


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), residue(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints keep the document with the smallest id."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into training sequences: one row per piece."""
    pieces = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), memo=700_000)  # executors also hold the other stages' memory
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", pack),
]

#: The stages with trained models and tokenizers have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; only the last one's result stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with swept(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
