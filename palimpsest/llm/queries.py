"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe_chunks, exact_dedup, language, licenses, packing, quality, simhash, token_store, topk, toxicity
from palimpsest.llm.common import residue, table
from palimpsest.llm.tokens import vocabulary


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_chunks.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), residue(F.col("doc_id"), 5)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), residue(F.col("doc_id"), 3)
    model = language.train(docs, fold != 1)
    return language.identify(docs, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), residue(F.col("doc_id"), 5)
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    docs = token_store.read_tokens(shards).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_store.with_global_start(docs, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_chunk_reuse": op1_bpe_chunk_reuse,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_quality": op4_quality,
        "op5_license_scan": op5_license_scan,
        "op6_simhash": op6_simhash,
        "op7_packing": op7_packing,
        "op8_token_store": op8_token_store,
        "op9_ball_tree_topk": op9_ball_tree_topk,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_ball_tree_topk": """
            with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
                       where embedding is not null and vec_id is not null
                         and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
                 s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
                       from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
                 r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
            select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
        """,
        "op10_exact_dedup": """
            with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
                 g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
            select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, d.text_sha256
            from d join g on d.text_sha256 = g.text_sha256
        """,
    }
