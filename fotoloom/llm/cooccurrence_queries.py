"""Problem 4: tags that stand on the same photo."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotoloom.llm.cooccurrence import cooccurrence
from fotoloom.operators.canonical import canonical_photos
from fotoloom.sources.tables import table

MIN_PHOTOS = 5
MIN_SHARE = 2000  # of so many photos at least one
MIN_LIFT = 5


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tags with its counts and scores."""
    found = cooccurrence(canonical_photos(table(spark, folder, "photos"), "tags"), "tags")
    return found.select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), F.col("n_ab").alias("photos_ab"), F.col("n_a").alias("photos_a"),
        F.col("n_b").alias("photos_b"), F.col("n").alias("photos"), F.round("lift", 6).alias("lift"), F.round("npmi", 6).alias("npmi"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return (
        p4_pairs(spark, folder)
        .where(
            (F.col("photos_ab") >= MIN_PHOTOS)
            & (MIN_SHARE * wide("photos_ab") >= wide("photos"))
            & (wide("photos_ab") * wide("photos") >= MIN_LIFT * (wide("photos_a") * wide("photos_b")))
        )
        .select("tag_a", "tag_b")
    )


_BASKETS = """
WITH kept AS (SELECT id, tags FROM (SELECT *, row_number() OVER (PARTITION BY lower(file_path) ORDER BY id) AS nth FROM photos) WHERE nth = 1),
  items AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM (SELECT id, unnest(tags) AS t FROM kept) WHERE trim(t) <> ''),
  one AS (SELECT t, count(*) AS n FROM items GROUP BY t),
  total AS (SELECT count(DISTINCT id) AS n FROM items),
  pairs AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM items a JOIN items b ON a.id = b.id AND a.t < b.t GROUP BY 1, 2)
"""
QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
SQL = {
    "p4_found": f"""{_BASKETS}
SELECT p.a AS tag_a, p.b AS tag_b FROM pairs p JOIN one x ON x.t = p.a JOIN one y ON y.t = p.b, total
WHERE p.n >= 5 AND 2000 * p.n >= total.n AND p.n::HUGEINT * total.n >= 5 * x.n::HUGEINT * y.n""",
    "p4_pairs": f"""{_BASKETS}
SELECT p.a AS tag_a, p.b AS tag_b, p.n AS photos_ab, x.n AS photos_a, y.n AS photos_b, total.n AS photos,
  round(p.n::DOUBLE * total.n / (x.n::DOUBLE * y.n), 6) AS lift,
  round(CASE WHEN p.n = total.n THEN 1.0 ELSE log2(p.n::DOUBLE * total.n / (x.n::DOUBLE * y.n)) / -log2(p.n::DOUBLE / total.n) END, 6) AS npmi
FROM pairs p JOIN one x ON x.t = p.a JOIN one y ON y.t = p.b, total""",
}
