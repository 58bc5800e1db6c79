"""Queries of the text problems and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import bpe, packing, quality
from gaugeflow.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_column(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_kinds(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.no_prose(p10_statistics(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_ids, p9_containers, p10_statistics, p10_found)}

ORACLE: dict[str, str] = {}
