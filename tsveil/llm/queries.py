"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsveil.llm import decontamination, jaccard, langid, lm, media, packing, repeats, sharding, token_counts, wrappers
from tsveil.llm.base import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("spans")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_media, op2_jaccard, op3_language, op4_decontamination, op5_lm_score, op6_packing, op7_sharding, op8_main_text, op9_token_counts, op10_repeats)}

ORACLE_SQL: dict[str, str] = {"op2_jaccard": jaccard.components_sql(), "op10_repeats": repeats.repeats_sql(), "op4_decontamination": decontamination.matches_sql(), "op6_packing": packing.packing_sql(), "op7_sharding": sharding.placement_sql()}
