"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import bpe, decontaminate, exact_dedup, html_extract, license_scan, lm_score, minhash, quality, sharding, url_filter, vector_codes, warc, yinyang
from scriptorium.llm._common import table

RANKS = "byte_bpe_50k.tiktoken"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), width=2)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"))


def op12_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.judge(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.quantise(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_quality_rules, op4_html, op5_warc, op6_minhash, op7_lm_score, op8_sharding, op9_license_scan, op10_bpe, op11_yinyang, op12_block_naming, op13_vector_codes)}

ORACLE_SQL = {"op2_url_filter": url_filter.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op7_lm_score": lm_score.ORACLE_SQL, "op11_yinyang": yinyang.oracle_sql(), "op12_block_naming": exact_dedup.ORACLE_SQL, "op13_vector_codes": vector_codes.oracle_sql()}
