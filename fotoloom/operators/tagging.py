"""Zero-shot tagging of image vectors against a vocabulary of categories.

The vocabulary goes to every task as a matrix; it is refused beyond `MOST_CATEGORIES` rows and does not grow with the
photos. Scoring is a matrix product over Arrow batches: the same expression over array columns would interpret a lambda
per component and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotoloom.config import DEFAULTS, CurationConfig
from fotoloom.functions.tags import catalog_tags, with_person, without_synonyms
from fotoloom.functions.vectors import catalog_vector

MOST_CATEGORIES = 5_000


class _Vocabulary:
    """The categories as a matrix, with their valid tags in order; "Other" is no valid tag."""

    def __init__(self, categories: DataFrame):
        rows = categories.where("category_idx is not null").select("category_idx", "tags", "embedding").orderBy("category_idx").limit(MOST_CATEGORIES + 1).collect()
        if len(rows) > MOST_CATEGORIES:
            raise ValueError(f"more than {MOST_CATEGORIES} categories")
        self.index = np.array([r.category_idx for r in rows], np.int64)
        self.size = np.array([len(r.embedding or []) for r in rows], np.int64)
        self.matrix = np.zeros((len(rows), int(self.size.max(initial=0))), np.float32)
        for k, r in enumerate(rows):
            self.matrix[k, : self.size[k]] = [x or 0.0 for x in r.embedding or []]
        self.tags = [[(k * 1_000_000 + i, t) for i, t in enumerate(r.tags or []) if t and t != "Other"] for k, r in enumerate(rows)]

    def fallback(self, k: int) -> list[str]:
        """A category's own tags, each once, letter case ignored."""
        return list({t.lower(): t for _, t in reversed(self.tags[k])}.values())[::-1]

    def passing(self, scores: np.ndarray, least: np.float32) -> list[str]:
        best: dict[str, tuple[float, int, str]] = {}
        for k in np.flatnonzero(scores >= least):
            for place, tag in self.tags[k]:
                p, first, spelling = best.get(tag.lower(), (-1.0, place, tag))
                best[tag.lower()] = (max(p, float(scores[k])), first, spelling)
        return [t for _, _, t in sorted(best.values(), key=lambda x: (-x[0], x[1]))]

    def scores(self, rows: np.ndarray, cfg: CurationConfig) -> np.ndarray:
        """Probabilities, a row per vector (equal lengths): products in single precision, sums in double."""
        norm = np.sqrt((rows * rows).astype(np.float64).sum(1))
        unit = np.where(norm[:, None] > 0, rows / np.where(norm > 0, norm, 1)[:, None], rows).astype(np.float32)
        n = min(rows.shape[1], self.matrix.shape[1])
        dots = np.empty((len(rows), len(self.index)))
        for at in range(0, len(rows), 128):
            dots[at : at + 128] = (unit[at : at + 128, None, :n] * self.matrix[None, :, :n]).sum(2, dtype=np.float64)
        scale, bias = np.exp(np.float64(np.float32(cfg.logit_scale))), np.float64(np.float32(cfg.logit_bias))
        return (1 / (1 + np.exp(-(dots * scale + bias)))).astype(np.float32)


def _by_length(column: pa.Array):
    """Usable vectors of a batch, grouped by length: (rows of the batch, matrix)."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    ok = np.asarray(column.is_valid()) & (sizes > 0)
    for n in np.unique(sizes[ok]):
        at = np.flatnonzero(ok & (sizes == n))
        m = flat[offsets[:-1][at][:, None] + np.arange(n)]
        whole = ~np.isnan(m).any(1)
        if whole.any():
            yield at[whole], m[whole]


def category_scores(vectors: DataFrame, categories: DataFrame, cfg: CurationConfig = DEFAULTS, row_id: str = "id", vector: str = "feature_vector") -> DataFrame:
    """`row_id`, `category_idx`, `p`: each usable vector's probability under each category. An empty or null embedding scores
    as a zero vector, a null component as 0; a null index is no category; unusable vectors have no scores."""
    words = _Vocabulary(categories)
    slim = vectors.select(row_id, F.col(vector).cast("array<float>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in _by_length(b.column(1)):
                p = words.scores(m, cfg)
                k = p.shape[1]
                ids = b.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(words.index, len(at)).astype(np.int32)), pa.array(p.ravel())], names=[row_id, "category_idx", "p"])

    kind = slim.schema[row_id].dataType.simpleString()
    return slim.mapInArrow(run, f"`{row_id}` {kind}, category_idx int, p float")


def _tagged(vectors: pa.Array, words: _Vocabulary, cfg: CurationConfig) -> tuple[pa.Array, pa.Array]:
    """Tags, before synonyms are dropped, and confidence of each vector."""
    tags: list[list[str]] = [[] for _ in range(len(vectors))]
    confidence, least = np.zeros(len(vectors), np.float32), np.float32(cfg.tag_min_probability)
    for at, m in _by_length(vectors) if len(words.index) else ():
        for row, p in zip(at, words.scores(m, cfg)):
            best = int(p.argmax())
            confidence[row] = min(max(p[best], 0.0), 1.0)
            tags[row] = words.passing(p, least) or words.fallback(best)
    return pa.array(tags, pa.list_(pa.string())), pa.array(confidence)


def _named(tags: str | Column) -> Column:
    left = without_synonyms(tags)
    return F.when(F.size(left) > 0, left).otherwise(F.array(F.lit("Other")))


def zero_shot_tags(vectors: DataFrame, categories: DataFrame, cfg: CurationConfig = DEFAULTS, row_id: str = "id", vector: str = "feature_vector") -> DataFrame:
    """`row_id`, `tags`, `confidence` of every row. A tag's score is its best category's, letter case ignored, in the
    spelling first met; tags from the threshold on stand by score, then place. If none passes, the tags of the best category
    stand (the lowest index on ties); if nothing is left, or there is no usable vector, "Other". Nothing is shuffled."""
    words = _Vocabulary(categories)
    slim = vectors.select(row_id, F.col(vector).cast("array<float>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_tagged(b.column(1), words, cfg)], names=[row_id, "_t", "confidence"])

    kind = slim.schema[row_id].dataType.simpleString()
    found = slim.mapInArrow(run, f"`{row_id}` {kind}, _t array<string>, confidence float")
    return found.select(row_id, _named("_t").alias("tags"), "confidence")


def tags_beside(rows: DataFrame, categories: DataFrame, cfg: CurationConfig = DEFAULTS, vector: str = "feature_vector") -> DataFrame:
    """`rows` with `_tags`, the tags that `zero_shot_tags` gives; only the vectors go to Python."""
    words = _Vocabulary(categories)

    def tagged(v: pa.Array) -> pa.Array:
        return _tagged(v, words, cfg)[0]

    tagged.__annotations__ = {"v": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(tagged, "array<string>")
    return rows.withColumn("_tags", udf(F.col(vector).cast("array<float>"))).withColumn("_tags", _named("_tags"))


def analysis_route() -> Column:
    """How a photo is analyzed: its tags are kept, its vector is classified, or its image has to be read."""
    return (
        F.when(F.size(catalog_tags("tags")) > 0, "tags").when(catalog_vector("feature_vector").isNotNull(), "vector").otherwise("image")
    )


def analyze(photos: DataFrame, categories: DataFrame, images: DataFrame | None = None, cfg: CurationConfig = DEFAULTS) -> DataFrame:
    """`photos` after analysis; three disjoint branches, of which only the last needs image results.

    images: `file_path`, `sharpness_score`, `face_count`, `feature_vector`, `exif_date` (nullable) of photos of the last branch;
    paths must be unique in both. Those without image results count as analyzed, with "Other" and no scores.
    """
    routed = photos.withColumn("_route", analysis_route())
    kept = routed.where("_route = 'tags'").withColumn("tags", catalog_tags("tags")).withColumn("is_analyzed", F.lit(True)).drop("_route")

    def tagged(rows: DataFrame) -> DataFrame:
        # Beside the row they belong to rather than joined to it: new photos have no id yet, and nothing is shuffled.
        found = tags_beside(rows, categories, cfg)
        return (
            found.withColumn("tags", with_person("_tags", F.coalesce("face_count", F.lit(0))))
            .withColumn("is_analyzed", F.lit(True))
            .select(rows.columns)
        )

    by_vector = tagged(routed.where("_route = 'vector'").drop("_route"))
    rest = routed.where("_route = 'image'").drop("_route")
    if images is not None:
        seen = images.select(
            F.col("file_path").alias("_path"), F.col("sharpness_score").alias("_s"), F.col("face_count").alias("_f"), F.col("feature_vector").alias("_v"), F.col("exif_date").alias("_d")
        )
        rest = (
            rest.join(seen, F.col("file_path") == F.col("_path"), "left")
            .withColumn("sharpness_score", F.coalesce("_s", F.lit(0.0)))
            .withColumn("face_count", F.coalesce("_f", F.lit(0)))
            .withColumn("feature_vector", F.col("_v"))
            .withColumn("date_taken", F.coalesce("_d", "date_taken") if cfg.use_exif_date else F.col("date_taken"))
            .drop("_path", "_s", "_f", "_v", "_d")
        )
    return kept.unionByName(by_vector).unionByName(tagged(rest))
