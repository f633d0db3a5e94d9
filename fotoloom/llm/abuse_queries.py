"""Problem 8: documents with abusive, hateful or sexual language, and their rate per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotoloom.llm.abuse import score_documents, source_rates
from fotoloom.sources.tables import spread, table


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(spread(table(spark, folder, "documents"), "doc_id"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("abusive").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return source_rates(score_documents(spread(table(spark, folder, "documents"), "doc_id"), "doc_id", "text", "source"), "source")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}  # tested against judged examples instead
