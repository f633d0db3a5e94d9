"""Problem 6: every document as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fotoloom.llm.encoding import encode_corpus
from fotoloom.sources.tables import spread, table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(spread(table(spark, folder, "documents"), "doc_id"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}  # tested against two other encoders instead
