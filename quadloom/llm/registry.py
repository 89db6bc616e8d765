"""Queries of the subpackage for the driver contract, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import decontaminate, html_text, language_id, mixing, near_dup, quality_rules, sharding, token_output, url_filter, warc_fixity


def _on(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _on("documents", language_id.query),
        "op2_decontaminate": _decontaminate,
        "op3_html_text": _on("pages", html_text.query),
        "op4_sharding": _on("documents", sharding.query),
        "op5_near_dup": _on("documents", near_dup.query),
        "op6_mixing": _on("documents", mixing.query),
        "op7_token_output": _on("documents", token_output.query),
        "op8_quality_rules": _on("documents", quality_rules.query),
        "op9_url_filter": _on("pages", url_filter.query),
        "op10_warc_fixity": _on("pages", warc_fixity.query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_language_id": language_id.sql(),
        "op2_decontaminate": decontaminate.sql(),
        "op3_html_text": html_text.SQL,
        "op4_sharding": sharding.sql(),
        "op5_near_dup": near_dup.sql(),
        "op6_mixing": mixing.sql(),
        "op8_quality_rules": quality_rules.SQL,
        "op9_url_filter": url_filter.SQL,
        "op10_warc_fixity": warc_fixity.SQL,
    }
