"""The operators' queries over the whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import bit_codes, bpe_model, divergence, fingerprints, jaccard_join, language, line_dedup, packing, sharding, token_store, topk, url_filter, whitening
from lexspark.llm.common import shared_dir, table
from lexspark.llm.tokens import vocabulary_path


def op1_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(table(spark, sf_dir, "pages"))


def op2_range_coded_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    return token_store.query(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), place)


def op3_lsh_forest_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(table(spark, sf_dir, "documents"))


def op4_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op5_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.query(table(spark, sf_dir, "documents"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op7_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(table(spark, sf_dir, "embeddings"))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


def op9_content_defined_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(table(spark, sf_dir, "documents"))


def op10_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_model.query(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.query(table(spark, sf_dir, "documents"))


def op13_rotated_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_codes.query(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_temporal_url_filter,
        op2_range_coded_token_files,
        op3_lsh_forest_jaccard_join,
        op4_balanced_label_propagation,
        op5_nearest_centroid_language,
        op6_fuzzy_line_dedup,
        op7_block_pruned_top_k,
        op8_sum_of_squares_packing,
        op9_content_defined_fingerprints,
        op10_byte_bpe_codec,
        op11_tsqr_whitening,
        op12_source_divergence,
        op13_rotated_bit_codes,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_temporal_url_filter": url_filter.ORACLE_SQL, "op7_block_pruned_top_k": topk.ORACLE_SQL, "op12_source_divergence": divergence.ORACLE_SQL}
