"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import covertree, langid_ecoc, line_crf, minmax_dedup, mixing, packing, quality_knn, sharding, url_rules, warc_zip
from tessera.runtime import table


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op3_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_ecoc.identified(table(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_knn, op2_warc_zip, op3_langid_ecoc, op4_line_crf, op5_url_rules, op6_covertree, op7_minmax_dedup, op8_mixing, op9_sharding, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_zip": warc_zip.ORACLE, "op6_covertree": covertree.ORACLE, "op7_minmax_dedup": minmax_dedup.ORACLE, "op8_mixing": mixing.ORACLE}
