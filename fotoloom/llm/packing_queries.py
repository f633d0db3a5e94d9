"""Problem 7: all documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.llm.encoding import token_counts
from fotoloom.llm.packing import GROUP_ITEMS, fill_containers
from fotoloom.scratch import materialize
from fotoloom.sources.tables import spread, table

CAPACITY = 2048


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents"), "doc_id").select(
        "doc_id", "text", F.lower(F.btrim("source")).alias("source"), F.xxhash64("text").alias("copies")
    )
    return token_counts(documents, "doc_id", "text", "source", "copies")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of a text never share a container."""
    return fill_containers(_sized(spark, folder), "doc_id", "tokens", CAPACITY, cluster="copies", source="source")


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of `p7_containers`, counted over all its rows: documents laid, pieces that overlap or leave gaps, containers
    that hold too much, containers with two copies of a text, and whether there are at most 1.005 containers (and one a
    group) for what all tokens would fill."""
    sized = materialize(_sized(spark, folder).select("doc_id", "tokens", "copies"), "sized")
    laid = materialize(fill_containers(sized, "doc_id", "tokens", CAPACITY, cluster="copies"), "laid")
    whole = laid.groupBy("doc_id").agg(F.sum("length").alias("laid"), F.max(F.col("start") + F.col("length")).alias("end"))
    documents = sized.join(whole, "doc_id", "left").agg(
        F.count("laid").alias("documents"), F.count(F.when(~((F.col("laid") == F.col("tokens")) & (F.col("end") == F.col("tokens"))), 1)).alias("wrong"), F.sum("tokens").alias("_tokens")
    )
    # A copy that is cut, or without tokens, conflicts with nothing by its full pieces: only the rest of a document has a cluster.
    rest = laid.where((F.col("length") > 0) & (F.col("length") < CAPACITY)).join(sized.select("doc_id", "copies").where("copies is not null"), "doc_id")
    twice = rest.groupBy("container", "copies").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("copies_together"))
    filled = laid.groupBy("container").agg(F.sum("length").alias("n")).agg(F.count(F.when(F.col("n") > CAPACITY, 1)).alias("overfull"), F.count(F.lit(1)).alias("_containers"))
    return documents.crossJoin(twice).crossJoin(filled).select(  # one row each
        "documents", "wrong", "copies_together", "overfull",
        (F.col("_containers") <= 1.005 * F.col("_tokens") / CAPACITY + 1 + F.floor(F.col("documents") / GROUP_ITEMS)).alias("tight"),
    )


QUERIES = {"p7_containers": p7_containers, "p7_check": p7_check}
# The containers themselves are tested against their rules and brute force.
SQL = {"p7_check": "SELECT count(*) AS documents, 0::BIGINT AS wrong, 0::BIGINT AS copies_together, 0::BIGINT AS overfull, true AS tight FROM documents"}
