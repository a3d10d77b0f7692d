"""Documents with text that was decoded with the wrong character encoding (p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.garbled_text import find_garbled, repair_garbled
from strandwise.plans.tables import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_garbled(_documents(spark, folder), "doc_id", "text")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return repair_garbled(_documents(spark, folder), "doc_id", "text")


SQL: dict[str, str] = {}

QUERIES = {"p8_found": p8_found, "p8_restored": p8_restored}
