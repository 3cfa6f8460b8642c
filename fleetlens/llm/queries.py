"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import ann, codes, filter_audit, imatch, jaccard, language, packing, passages, pieces, sharding, surrogates, token_files, url_reputation

PACKING_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL, PIECE_SEED = "piece_bpe_32k.model", 20240601
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group_documents(table(spark, sf_dir, "documents"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_entities(docs).withColumn("n_replaced", F.size("spans").cast("long"))


def op7_script_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PACKING_TOKENIZER)
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, with_ids=False)


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL), PIECE_SEED)


def op11_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op12_limb_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_filter_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cross_polytope": op1_cross_polytope,
    "op2_compact_windows": op2_compact_windows,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_url_reputation": op4_url_reputation,
    "op5_imatch": op5_imatch,
    "op6_surrogates": op6_surrogates,
    "op7_script_viterbi": op7_script_viterbi,
    "op8_nnls_packing": op8_nnls_packing,
    "op9_minimax_shards": op9_minimax_shards,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_huffman_files": op11_huffman_files,
    "op12_limb_codes": op12_limb_codes,
    "op13_filter_paths": op13_filter_paths,
}
