"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.audio_features import audio_features, rendered_texts
from spanforge.llm.bpe import bpe_encode
from spanforge.llm.common import table
from spanforge.llm.html_extract import extract_html
from spanforge.llm.language_id import identify_languages
from spanforge.llm.license_scan import license_scan, license_scan_sql
from spanforge.llm.line_templates import drop_recurring_lines
from spanforge.llm.mixing import mixing_rates
from spanforge.llm.ngram_jaccard import ngram_jaccard_join, ngram_jaccard_sql
from spanforge.llm.order_minhash import order_minhash
from spanforge.llm.toxicity import toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(table(spark, sf_dir, "documents"))


def op4_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(rendered_texts(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_order_minhash": op3_order_minhash,
    "op4_mixing_rates": op4_mixing_rates,
    "op5_audio_features": op5_audio_features,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_bpe": op10_bpe,
}

#: The other operators have no SQL: templates, tilting, sketches, forward sums and merges are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op1_license_scan": license_scan_sql(), "op9_ngram_jaccard_join": ngram_jaccard_sql()}
