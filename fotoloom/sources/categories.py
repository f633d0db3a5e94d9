"""The tag vocabulary of a model, as JSON or as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotoloom.config import DEFAULTS, CurationConfig
from fotoloom.schema import CATEGORIES

_JSON = T.StructType(
    [
        T.StructField("LogitScale", T.FloatType()),
        T.StructField("LogitBias", T.FloatType()),
        T.StructField("EmbeddingDimension", T.IntegerType()),
        T.StructField(
            "Categories",
            T.ArrayType(
                T.StructType(
                    [T.StructField("Prompt", T.StringType()), T.StructField("Tags", T.ArrayType(T.StringType())), T.StructField("Embedding", T.ArrayType(T.FloatType()))]
                )
            ),
        ),
    ]
)


def fallback_categories(spark: SparkSession, dim: int = 768) -> DataFrame:
    """What stands in for a missing vocabulary: one category tagged "Other" with a zero vector."""
    return spark.createDataFrame([(0, "other", ["Other"], [0.0] * dim)], CATEGORIES)


def read_categories(spark: SparkSession, *paths: str, cfg: CurationConfig = DEFAULTS) -> tuple[DataFrame, CurationConfig]:
    """The first readable vocabulary of the paths with its scale and bias; the fallback if there is none."""
    from dataclasses import replace

    for path in paths:
        try:
            model = spark.read.schema(_JSON).json(path, multiLine=True)
            head = model.select("LogitScale", "LogitBias", "EmbeddingDimension", F.size("Categories").alias("n")).first()
        except Exception:  # unreadable: the next place is tried
            continue
        if head is None or not head.n or head.n < 0:
            continue
        rows = model.select(F.posexplode("Categories").alias("category_idx", "c")).select(
            "category_idx", F.col("c.Prompt").alias("prompt"), F.coalesce("c.Tags", F.array().cast("array<string>")).alias("tags"), F.col("c.Embedding").alias("embedding")
        )
        scale = head.LogitScale if head.LogitScale is not None else cfg.logit_scale
        bias = head.LogitBias if head.LogitBias is not None else cfg.logit_bias
        return rows, replace(cfg, logit_scale=scale, logit_bias=bias)
    return fallback_categories(spark), cfg
