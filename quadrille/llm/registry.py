"""Queries p1, p6, p7 and p8. SQL cannot state them; the tests hold them against brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import canonical, leakage, tokens, truncation
from quadrille.runtime import table


def _programs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "programs").select(F.col("program_id").alias("key"), F.col("program_name").alias("name"), F.col("program_code").alias("code"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "program_requirements").select("req_id", "program_name").distinct()
    return canonical.map_rows(rows, "program_name", _programs(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("req_id", F.col("key").alias("program_id")).distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    lost = _mapped(spark, d).where(F.col("key") == -1)
    return lost.groupBy("program_name").agg(F.count("*").alias("requirements"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    out = tokens.encode_table(table(spark, d, "documents"), "doc_id", "text")
    return out.select(F.col("key").alias("doc_id"), "ids")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")
    return found.select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is in, with the longest passage."""
    found = leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text").distinct()
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_cut(table(spark, d, "documents"), "doc_id", "text")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return truncation.cut_rates(docs, truncation.find_cut(docs, "doc_id", "text"), "doc_id", "source")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p6_ids, p7_found, p7_items, p8_found, p8_rates)}
ORACLE: dict[str, str] = {}
