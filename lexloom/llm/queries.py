"""The registered queries of the training-data operators, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import binary, licences, lm, media, mixing, neighbours, packing, quality, simhash, substring
from lexloom.llm.common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.query(read_table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_media(media.texts_as_media(read_table(spark, sf_dir, "documents"))))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(read_table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read_table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_model": op2_language_model,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_media_columns": op4_media_columns,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_binary": op6_token_binary,
    "op7_licence_scan": op7_licence_scan,
    "op8_simhash_groups": op8_simhash_groups,
    "op9_nearest_vectors": op9_nearest_vectors,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE_SQL,
    "op7_licence_scan": licences.oracle_sql(),
    "op10_source_mixing": mixing.ORACLE_SQL,
}
